"""Folds and bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(doc_id, n: int) -> F.Column:
    """crc32 of the id as text, modulo ``n`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def held_out(doc_id, n: int, rest: int = 2) -> F.Column:
    """Whether the id's fold is the one kept from training (false for a null id)."""
    return F.coalesce(fold(doc_id, n) == rest, F.lit(False))


def bounded_sample(rows: DataFrame, label: str, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``per_class`` rows (id, label, weight) of each label, the first by a hash of
    the id; ``weight`` is how many rows each stands for.  A hash threshold thins the rows
    before the exact cut, so what is sorted stays near the bound."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col(id_col), F.lit(17))
    parts = []
    for value, n in sorted(counts.items()):
        one = rows.filter(F.col(label) == value).select(id_col, label)
        share = 1.5 * per_class / n
        if share < 1:
            one = one.filter(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)))
        parts.append(one.orderBy(order, id_col).limit(per_class)
                     .withColumn("weight", F.lit(max(1.0, n / per_class))))
    if not parts:
        return rows.select(id_col, label).withColumn("weight", F.lit(1.0)).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
