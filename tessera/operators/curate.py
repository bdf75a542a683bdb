"""Row curation: prune, keep-last de-duplication, containment filter and categorisation.

``finalize`` applies them in the fixed order prune -> keep-last -> containment flag ->
keep contained -> categorise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import contains_word
from ..functions.text import digits_value, is_decimal_digits, is_digits, py_str, py_strip
from .common import keep_last

# --- fixed values ---------------------------------------------------------------------------
RESEARCH_PROBLEM_PREDICATE = "has research problem"
LOCATION_PREDICATES = ("country, city, location, continent", "has location", "study location",
                       "countries")
DEDUP_KEYS = ("PaperId", "PredicateLabel", "ObjectLabel")
POS_ADJ, POS_NOUN = "ADJ", "NOUN"
MIN_LABEL_CHARS = 3          # shorter labels are pruned
SMALL_NUMBER = 999           # all-digit labels below this are pruned
YEAR_FROM, YEAR_TO = 1000, 2100  # all-digit labels in [from, to) are years
PHRASE_MAX_TOKENS = 5        # fewer space tokens: word or phrase; else sentence
# Category names, in rule order.
(CAT_RESEARCH_PROBLEM, CAT_YEAR, CAT_URL, CAT_LOCATION, CAT_NUMBER, CAT_MEASUREMENT,
 CAT_ACRONYM, CAT_ADJ, CAT_NOUN, CAT_UNKNOWN, CAT_ADJ_PHRASE, CAT_NOUN_PHRASE, CAT_SENTENCE) = (
    "research problem", "year/date", "url", "location", "number", "count/measurement",
    "acronym", "adj", "noun", "unknown", "adj phrase", "noun phrase", "sentence")
# ---------------------------------------------------------------------------------------------


def prune_condition(label) -> Column:
    """True for rows the unwanted-row rule drops: fewer than 3 characters after strip, or an
    all-digit (unstripped) label below 999.  A missing label reads as 'nan' and stays."""
    raw = py_str(F.col(label) if isinstance(label, str) else label)
    short = F.char_length(py_strip(raw)) < MIN_LABEL_CHARS
    small_number = F.coalesce(is_decimal_digits(raw) & (digits_value(raw) < SMALL_NUMBER),
                              F.lit(False))
    return short | small_number


def prune_rows(df: DataFrame, label: str = "ObjectLabel") -> DataFrame:
    """Drop unwanted rows (see ``prune_condition``)."""
    return df.filter(~prune_condition(label))


def pruned_count(df: DataFrame, label: str = "ObjectLabel") -> DataFrame:
    """B4 report: number of pruned rows, as a one-row frame."""
    return df.agg(F.count_if(prune_condition(label)).alias("pruned"))


def dedupe_keep_last(df: DataFrame, keys=DEDUP_KEYS, ord_col: str = "ord") -> DataFrame:
    """One row per key combination, the last by ``ord``; NULL keys are equal."""
    return keep_last(df, list(keys), ord_col)


def object_in_abstract(label, abstract) -> Column:
    """NULL if either side is missing, else lower(label) is a substring of lower(abstract)."""
    label = F.col(label) if isinstance(label, str) else label
    abstract = F.col(abstract) if isinstance(abstract, str) else abstract
    return F.contains(F.lower(abstract), F.lower(label))


def object_word_in_abstract(label, abstract) -> Column:
    """NULL if either side is missing, else the label occurs as a whole word
    (case-insensitive, Unicode word boundaries)."""
    return contains_word(label, abstract)


def flag_object_in_abstract(df: DataFrame, label: str = "ObjectLabel",
                            abstract: str = "PaperAbstract") -> DataFrame:
    return df.withColumn("ObjectInAbstract", object_in_abstract(label, abstract))


def keep_contained(df: DataFrame, flag: str = "ObjectInAbstract") -> DataFrame:
    """Keep rows whose flag is true (false and NULL go)."""
    return df.filter(F.col(flag))


def _pos_lookup(df: DataFrame, key: Column, pos: DataFrame | None) -> DataFrame:
    if pos is None:
        return df.withColumn("_pos", F.lit(None).cast("string"))
    # One tag per token (a token with several tags gets the smallest, deterministically).
    tags = pos.groupBy(F.col("token").alias("_key")).agg(F.min("pos").alias("_pos"))
    return (df.withColumn("_key", key)
            .join(tags, "_key", "left").drop("_key"))


def _pos_key(lab: Column, strict_reference: bool) -> Column:
    tokens = F.split(lab, " ", -1)
    phrase_key = F.substring(lab, -1, 1) if strict_reference else F.element_at(tokens, -1)
    return F.when(F.size(tokens) == 1, lab).when(F.size(tokens) < PHRASE_MAX_TOKENS, phrase_key)


def pos_tokens(df: DataFrame, strict_reference: bool = True, label: str = "ObjectLabel") -> DataFrame:
    """(token): the distinct tokens that ``categorize`` looks up in its ``pos`` table."""
    token = _pos_key(py_strip(py_str(F.col(label))), strict_reference)
    return df.select(token.alias("token")).filter("token is not null").distinct()


def categorize(df: DataFrame, pos: DataFrame | None = None, strict_reference: bool = True,
               label: str = "ObjectLabel", predicate: str = "PredicateLabel",
               out: str = "Category") -> DataFrame:
    """The ordered category rules, first hit wins.

    ``pos`` is an optional (token, pos) lexicon, given or made by ``operators.tagger``;
    without it every part-of-speech branch yields 'unknown'.  ``strict_reference`` keeps
    the original behaviour: 'count/measurement' is never emitted, and 2-4 token phrases are
    tagged by their last character; ``False`` emits it and tags the last token."""
    lab = py_strip(py_str(F.col(label)))
    pred = F.col(predicate)
    value = digits_value(lab)
    number_shape = F.replace(
        F.regexp_replace(F.regexp_replace(lab, "^-+", ""), r"^([^.]*)[.]", "$1"),
        F.lit(","), F.lit(""))
    staged = _pos_lookup(df.withColumn("_lab", lab), _pos_key(lab, strict_reference), pos)
    lab, p = F.col("_lab"), F.col("_pos")
    tokens = F.split(lab, " ", -1)
    n_tok = F.size(tokens)
    rule = (
        F.when(F.lower(py_strip(pred)) == RESEARCH_PROBLEM_PREDICATE, CAT_RESEARCH_PROBLEM)
        .when(is_decimal_digits(lab) & (value >= YEAR_FROM) & (value < YEAR_TO), CAT_YEAR)
        .when(lab.startswith("http"), CAT_URL)
        .when(F.lower(pred).isin(*LOCATION_PREDICATES), CAT_LOCATION)
        .when(is_digits(number_shape), CAT_NUMBER)
    )
    if not strict_reference:
        rule = rule.when(F.exists(tokens, lambda t: t.rlike("^[0-9]")), CAT_MEASUREMENT)
    rule = (
        rule.when(lab.rlike(r"^[A-Z]+\z"), CAT_ACRONYM)
        .when(n_tok == 1, F.when(p == POS_ADJ, CAT_ADJ).when(p == POS_NOUN, CAT_NOUN)
              .otherwise(CAT_UNKNOWN))
        .when(n_tok < PHRASE_MAX_TOKENS, F.when(p == POS_ADJ, CAT_ADJ_PHRASE).when(p == POS_NOUN, CAT_NOUN_PHRASE)
              .otherwise(CAT_UNKNOWN))
        .otherwise(CAT_SENTENCE)
    )
    return staged.withColumn(out, rule).drop("_lab", "_pos")


def finalize(df: DataFrame, pos: DataFrame | None = None, strict_reference: bool = True,
             ord_col: str = "ord") -> DataFrame:
    """Prune -> keep-last on (PaperId, PredicateLabel, ObjectLabel) -> containment flag ->
    keep contained -> categorise."""
    out = prune_rows(df)
    out = dedupe_keep_last(out, DEDUP_KEYS, ord_col)
    out = flag_object_in_abstract(out)
    out = keep_contained(out)
    return categorize(out, pos, strict_reference)
