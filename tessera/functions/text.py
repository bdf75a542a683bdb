"""String column functions (Column -> Column), all JVM-side built-ins.

They reproduce the Python string semantics the dataset rules were written with
(``str.strip``, ``str.split``, ``str.capitalize``, ``str.isdigit`` ...) on Spark columns.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------
# The characters Python's str.isspace() accepts (str.strip() / str.split() remove them), in
# code point order: \t \n \v \f \r, the four information separators \x1c-\x1f, space,
# NEL \x85, NBSP \xa0, U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
PY_WHITESPACE_CODEPOINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
PY_WHITESPACE = "".join(map(chr, PY_WHITESPACE_CODEPOINTS))
# The same set as a regex character class (Java and RE2 both read \x{...}).
PY_WHITESPACE_CLASS = (
    r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Python's \w for str patterns: every letter, every number, and the underscore.
WORD_CLASS = r"[\p{L}\p{N}_]"
NON_WORD_CLASS = r"[^\p{L}\p{N}_]"
# Abstract markup removed by the sanitiser.
JATS_TAG = r"</?jats:[a-zA-Z0-9_]*>"
# Trailing characters the answer cleaner removes (one of them, once).
ANSWER_TRAILING = ".,;:-)(_+"
# Missing-value spellings of the pandas 1.4 CSV reader (its default na_values).
PANDAS_NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)
# -------------------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: Spark ``trim`` alone removes only spaces."""
    return F.trim(_c(c), F.lit(PY_WHITESPACE))


def capitalize(c) -> Column:
    """``str.capitalize()``: first character upper, the rest lower (not ``initcap``)."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def token_count(c) -> Column:
    """``len(x.split(" "))``: empty pieces count and ``''`` has one piece."""
    return F.size(F.split(_c(c), " ", -1))


def space_token(c, index) -> Column:
    """``x.split(" ")[index]`` (0-based), NULL when the text has fewer pieces."""
    idx = index if isinstance(index, Column) else F.lit(index)
    return F.get(F.split(_c(c), " ", -1), idx.cast("int"))


def sanitize_abstract(c) -> Column:
    """Abstract clean-up: NULL or '' -> NULL; markup tags -> space; strip; whitespace runs
    collapse to one space.  Tag-only input gives ''."""
    x = F.nullif(_c(c), F.lit(""))
    x = F.regexp_replace(x, JATS_TAG, " ")
    x = F.regexp_replace(x, PY_WHITESPACE_CLASS + "+", " ")
    return F.trim(x, F.lit(" "))


def ends_with_trailing_mark(c) -> Column:
    return F.substring(_c(c), -1, 1).isin(*list(ANSWER_TRAILING))


def clean_answer(c) -> Column:
    """Drop ONE trailing ``. , ; : - ) ( _ +`` and strip again; else unchanged."""
    c = _c(c)
    return F.when(ends_with_trailing_mark(c),
                  py_strip(F.substring(c, F.lit(1), F.char_length(c) - 1))).otherwise(c)


def _ranges(wanted) -> str:
    """The characters that ``wanted`` accepts, as ranges of a regex class."""
    points = [c for c in range(sys.maxunicode + 1) if wanted(chr(c))]
    runs: list[list[int]] = []
    for c in points:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


@functools.cache
def _digit_classes() -> tuple[str, str, str, str]:
    """(class of decimal digits, class of all that ``str.isdigit`` accepts, the non-ASCII
    decimal digits, the ASCII digits that they stand for), from Python's character data."""
    decimals = [chr(c) for c in range(128, sys.maxunicode + 1) if chr(c).isdecimal()]
    return (f"[{_ranges(str.isdecimal)}]", f"[{_ranges(str.isdigit)}]", "".join(decimals),
            "".join(str(unicodedata.decimal(d)) for d in decimals))


def is_decimal_digits(c) -> Column:
    """Every character is a decimal digit of some script: what ``int()`` can read.  (Other
    digits, such as superscripts, made ``int()`` fail in the original rules.)"""
    return _c(c).rlike(f"^{_digit_classes()[0]}+\\z")


def is_digits(c) -> Column:
    """``str.isdigit()``: decimal digits of any script, superscripts, circled digits ..."""
    return _c(c).rlike(f"^{_digit_classes()[1]}+\\z")


def digits_value(c) -> Column:
    """Integer value of a label of decimal digits (decimal(38,0); NULL when longer)."""
    _, _, other, ascii_ = _digit_classes()
    return F.translate(_c(c), other, ascii_).try_cast("decimal(38,0)")


def coerce_na(c, na_values=PANDAS_NA_VALUES) -> Column:
    """Opt-in CSV missing-value coercion: NA-like spellings become NULL."""
    c = _c(c)
    return F.when(c.isin(*na_values), F.lit(None).cast("string")).otherwise(c)


_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""


def list_literal(c) -> Column:
    """array<string> -> ``['R1', "R'2"]``: single quotes unless the item holds one and no
    double quote; backslashes and the quote itself are escaped; a null item is ``None``."""
    def item(x: Column) -> Column:
        x = F.regexp_replace(x, r"\\", r"\\\\")
        double = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
        single = F.concat(F.lit("'"), F.regexp_replace(x, "'", r"\\'"), F.lit("'"))
        return F.coalesce(F.when(double, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(single), F.lit("None"))

    return F.concat(F.lit("["), F.array_join(F.transform(_c(c), item), ", "), F.lit("]"))


def parse_id_list(c) -> Column:
    """A list literal written as text (``"['R1', \"R'2\"]"``) -> array<string>.  Both quote
    styles and escapes are read; text that is not such a list fails the job, so that no row
    disappears unseen."""
    c = _c(c)
    token = f"(?:{_QUOTED}|None)"
    whole = rf"(?s)^\s*\[\s*(?:{token}(?:\s*,\s*{token})*\s*,?)?\s*\]\s*\z"
    items = F.transform(
        F.regexp_extract_all(c, F.lit(f"(?s){token}"), 0),
        lambda t: F.when(t != "None", F.regexp_replace(F.substring(t, F.lit(2), F.char_length(t) - 2), r"(?s)\\(.)", "$1")))
    return F.when(c.rlike(whole), items).when(
        c.isNotNull(), F.raise_error(F.concat(F.lit("not a list literal: "), F.substring(c, 1, 200))))


def py_str(c) -> Column:
    """``str(x)`` of a missing value is the text 'nan'."""
    return F.coalesce(_c(c), F.lit("nan"))
