"""Answer-span and token-position column functions.

``answer_span`` finds the first case-insensitive, word-bounded occurrence of a label in a
text and returns code-point offsets ``(start, end)``, end exclusive, like Python's
``re.search(r'\\b(label)\\b', text, re.I).span()`` with the label taken literally.

Spark's ``regexp_instr`` counts UTF-16 units and is 1-based, and Java's ``\\b`` is not
Python's, so the span is computed as the code-point length of the text before the match
(``split(text, pattern, 2)``) with an explicit Unicode word boundary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NON_WORD_CLASS, PY_WHITESPACE_CLASS, WORD_CLASS, _c

# Default token provider for span -> token alignment: a run of word characters, or one
# character that is neither a word character nor whitespace.
TOKEN_PATTERN = (
    f"{WORD_CLASS}+|[^\\p{{L}}\\p{{N}}_{PY_WHITESPACE_CLASS[1:-1]}]"
)


def quote_literal(label) -> Column:
    """``\\Q label \\E`` with any ``\\E`` inside the label escaped."""
    return F.concat(F.lit("\\Q"), F.replace(_c(label), F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
                    F.lit("\\E"))


def word_pattern(label) -> Column:
    """Case-insensitive, Unicode-aware, word-bounded literal pattern for ``label``.

    Python's ``\\b`` before the label means "the previous character differs in wordness from
    the label's first character" (start of text counts as non-word), and likewise after it,
    so each side needs one look-around chosen by the label's first / last character."""
    label = _c(label)
    lit = quote_literal(label)
    first_word = F.substring(label, 1, 1).rlike("^" + WORD_CLASS)
    last_word = F.substring(label, -1, 1).rlike("^" + WORD_CLASS)
    # The literal comes first (most positions fail on its first character); the boundary
    # before it is then checked by a fixed-length look-behind over "<char><literal>".
    before = F.concat(F.when(first_word, F.lit("(?<!")).otherwise(F.lit("(?<=")),
                      F.lit(WORD_CLASS), lit, F.lit(")"))
    after = F.when(last_word, F.lit(f"(?!{WORD_CLASS})")).otherwise(F.lit(f"(?={WORD_CLASS})"))
    return F.concat(F.lit("(?iu)("), lit, F.lit(")"), before, after)


def contains_word(label, text) -> Column:
    """Boolean: ``label`` occurs in ``text`` as a whole word (NULL if either is NULL)."""
    label, text = _c(label), _c(text)
    # An empty label matches at any word boundary: wherever the text has a word character.
    return F.when(label == "", F.regexp_like(text, F.lit(WORD_CLASS))).otherwise(
        F.regexp_like(text, word_pattern(label)))


def span_start(label, text, pattern) -> Column:
    """Code-point offset of the first word-bounded match, NULL when none; ``pattern`` is
    ``word_pattern(label)``."""
    label, text = _c(label), _c(text)
    # "let pieces = ..." (an expression used twice would be evaluated twice)
    found = F.get(F.transform(F.array(F.split(text, pattern, 2)), lambda pieces: F.when(
        F.size(pieces) == 2, F.char_length(F.get(pieces, 0)))), 0)
    # An empty label matches at the first word boundary, i.e. at the first word character
    # (handled apart: a zero-width match at index 0 does not split).
    first_word = F.when(F.regexp_like(text, F.lit(WORD_CLASS)), F.char_length(
        F.regexp_extract(text, f"(?s)^({NON_WORD_CLASS}*){WORD_CLASS}", 1)))
    return F.when(label == "", first_word).otherwise(found)


def answer_span(label, text) -> Column:
    """struct<start:int, end:int> of the first word-bounded match, NULL when none."""
    label, text = _c(label), _c(text)
    start = span_start(label, text, word_pattern(label))
    # Case-insensitive literal matching is one code point for one code point, so the
    # match is exactly as long as the label.
    return F.get(F.transform(F.array(start), lambda s: F.when(
        s.isNotNull(), F.struct(s.alias("start"), (s + F.char_length(label)).alias("end")))), 0)


def token_index_at(text, pos, max_tokens: int | None = None) -> Column:
    """0-based index of the token containing code point ``pos`` of ``text`` under
    ``TOKEN_PATTERN``; NULL on whitespace, outside the text, or beyond ``max_tokens``."""
    text = _c(text)
    pos = pos if isinstance(pos, Column) else F.lit(pos)
    ch = F.substring(text, pos + 1, 1)
    idx = F.regexp_count(F.substring(text, F.lit(1), pos + 1), F.lit(TOKEN_PATTERN)) - 1
    inside = (pos >= 0) & (pos < F.char_length(text)) & ~ch.rlike("^" + PY_WHITESPACE_CLASS)
    idx = F.when(inside, idx)
    if max_tokens is not None:
        idx = F.when(idx < max_tokens, idx)
    return idx


__all__ = ["TOKEN_PATTERN", "NON_WORD_CLASS", "quote_literal", "word_pattern",
           "contains_word", "answer_span", "token_index_at"]


# --- raw-regex mode (the label used as an unescaped Python pattern) ---------------------------
# --- fixed value: the label, in any letter case, between word boundaries ----------------------
LABEL_PATTERN = r"\b({})\b"
# ---------------------------------------------------------------------------------------------


def _regex_span(label: str | None, text: str | None) -> tuple[int, int] | None:
    """Where the label, used as a pattern, first matches.  No bound on backtracking: a label such
    as ``(a+)+b`` can take very long, so this mode is for trusted labels only."""
    import re

    if label is None or text is None:
        return None
    try:
        match = re.search(LABEL_PATTERN.format(label), text, re.IGNORECASE)
    except (re.error, RecursionError, OverflowError):
        return None  # a bad pattern gives no span, as in the original
    return match.span() if match else None


def _regex_span_batch(labels, texts):
    import pandas as pd

    starts, ends = [], []
    for label, text in zip(labels, texts):
        span = _regex_span(label, text)
        starts.append(None if span is None else span[0])
        ends.append(None if span is None else span[1])
    return pd.DataFrame({"start": pd.array(starts, dtype="Int32"),
                         "end": pd.array(ends, dtype="Int32")})


def _make_regex_udf():
    from pyspark.sql.types import IntegerType, StructField, StructType

    schema = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])

    @F.pandas_udf(schema)
    def regex_span(labels, texts):
        return _regex_span_batch(labels, texts)

    return regex_span


def answer_span_regex(label, text) -> Column:
    """Q4 raw-regex mode: the label is an unescaped Python pattern inside ``\\b(...)\\b``
    (case-insensitive); an invalid pattern gives NULL.  Python ``re`` semantics need Python,
    so this runs as one Arrow-batched UDF; the literal ``answer_span`` is the default."""
    span = _make_regex_udf()(_c(label), _c(text))
    return F.when(span["start"].isNotNull(), span)


def contains_word_regex(label, text) -> Column:
    """B7 in raw-regex mode: NULL if either side is missing, else whether the pattern finds
    a word-bounded match (a bad pattern counts as no match)."""
    label, text = _c(label), _c(text)
    return F.when(label.isNotNull() & text.isNotNull(),
                  answer_span_regex(label, text).isNotNull())
