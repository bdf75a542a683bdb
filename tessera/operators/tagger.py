"""A part-of-speech tagger for the category rules (H12), trained from labelled tokens.

Training counts tags per lower-case token and per ending of one to three characters; each key
keeps its most frequent tag (ties: the smallest).  A token gets the tag of the longest thing known
about it: itself, its last three, two, one characters, else the most frequent tag of all.  Both
steps are aggregates and equi-joins over distinct keys, so neither the corpus nor the vocabulary
passes through the driver, and a frequent token counts as one row per task before any shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENDINGS = (3, 2, 1)  # characters of an ending, longest first


def train(labelled: DataFrame) -> DataFrame:
    """(chars, key, pos) from labelled tokens (token, pos): ``chars`` is 0 for whole tokens, -1 for the
    tag of all tokens (key ''), else the length of the ending.  Rows with a null or an empty
    token, or a null tag, don't count; an empty table gives an empty model."""
    counts = (labelled.filter("token != '' and pos is not null").groupBy(F.lower("token").alias("token"), "pos")
              .agg(F.count("*").alias("n")))
    keys = F.array(F.struct(F.lit(0).alias("chars"), F.col("token").alias("key")),
                   F.struct(F.lit(-1).alias("chars"), F.lit("").alias("key")),
                   *[F.struct(F.lit(k).alias("chars"), F.substring("token", -k, k).alias("key")) for k in ENDINGS])
    per = counts.select(F.explode(keys).alias("k"), "pos", "n").groupBy("k", "pos").agg(F.sum("n").alias("n"))
    # the most frequent first, then the smallest tag
    best = per.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("n"), "pos")).alias("best"))
    return best.select("k.chars", "k.key", F.col("best.pos").alias("pos"))


def lexicon(model: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, pos) for the distinct tokens of ``tokens`` (token); nulls and empty ones are left out,
    and with an empty model so are all."""
    out = tokens.filter("token != ''").select("token").distinct()
    low = F.lower("token")
    found = []
    for chars in (0, *ENDINGS):
        known = model.filter(F.col("chars") == chars).select(F.col("key").alias(f"_k{chars}"), F.col("pos").alias(f"_p{chars}"))
        key = low if chars == 0 else F.substring(low, -chars, chars)
        out = out.withColumn("_key", key).join(known, F.col("_key") == F.col(f"_k{chars}"), "left").drop("_key", f"_k{chars}")
        found.append(F.col(f"_p{chars}"))
    usual = model.filter("chars = -1").select("pos").scalar()  # one row
    return out.select("token", F.coalesce(*found, usual).alias("pos")).filter("pos is not null")
