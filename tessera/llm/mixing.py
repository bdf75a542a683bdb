"""Mixing sources to target weights by pivotal dependent rounding.

Every source (by code point, null last) gets a weight, and a target: its weight's share of
all sizes, at most ``cap`` times its own size, the excess reshared by weight until no source
is above its cap.  A document is then worth ``target / source size`` copies.  The whole part
is taken; the fraction is rounded by the pivotal method: two documents meet, word mass moves
from one to the other (at random, with odds that keep both expectations) until one of them is
all in or all out, and the other goes on.  The words taken from a source therefore stay
constant up to the last document that is still a fraction.

The rounding runs as a reduction tree: documents are dealt to leaves of bounded size by hash,
each leaf leaves at most one fraction, and the fractions meet again, ``FAN_IN`` leaves at a
time, until a source has one left.  All draws come from hashes of the seed and the documents,
so reruns agree.  A source with a third of all rows simply has more leaves.

A long document would stay a fraction until many short ones have moved it to 0 or 1, and its
last rounding would miss the target by up to half of it.  So fractions settle by size class
(powers of two), long to short: the one that a class leaves is rounded by its share, and the
words this adds or frees are taken from or passed on to the fractions of the shorter ones.
Documents of more than ``LONG`` of a mean leaf's words have a tree of their own before the
others (at most ``1 / LONG`` of them per leaf), whose rest all other documents of the source
share.  What is left at the end is half of a short document, unless the long ones outweigh
everything shorter."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, extended, masked, mix as splitmix, publish, text_chunks

CAP = 3.0
WEIGHTS = (1.0, 2.0, 3.0)
LEAF = 4096  # documents of a leaf, on average
FAN_IN = 64  # leaves whose fractions meet in the next level
LONG = 1 / 16  # documents of more than this share of a mean leaf's words settle before the others
SEED = 7


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (number of words; null text: 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [Words(buf, offs).counts() for _, _, buf, offs in text_chunks(b.column("text"))]
            size = np.concatenate(n) if n else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(size, pa.int64())],
                                             names=["doc_id", "source", "size"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, size long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, n (documents), target: one row per source.

    With the sources ordered by ``cap * size / weight``, those below some point get their cap
    and the others share what is left by weight; the point is the first at which the next
    source's cap is not below its share.  The windows run over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = (per.withColumn("_r", F.row_number().over(rank) - 1)
           .withColumn("_w", F.element_at(w, F.pmod("_r", F.lit(len(weights))) + 1))
           .withColumn("_cap", F.col("source_size") * F.lit(cap)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_r")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    per = per.withColumn("_level", rest / F.sum("_w").over(onward))  # words per weight from here on
    per = per.withColumn("_below", F.col("_cap") < F.col("_level") * F.col("_w"))
    # the level of the first source that does not reach its cap holds for all after it
    per = per.withColumn("_share", F.first(F.when(~F.col("_below"), F.col("_level")), True).over(everything))
    return per.select("source", "source_size", "n",
                      F.when(F.col("_below"), F.col("_cap"))
                      .otherwise(F.least("_cap", F.col("_share") * F.col("_w"))).alias("target"))


def _uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[seed, int(np.bitwise_xor.reduce(keys)) & (2**64 - 1)])
                               ).random(len(keys) + 1)


def pivot(size: np.ndarray, part: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding of the fractions ``part`` (each in (0, 1)) of documents of ``size``
    words, in the given order: (parts after it, position of the one that is still a fraction
    or -1).  The sum of ``size * part`` does not change."""
    p, s = part.tolist(), size.tolist()
    i = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if i < 0:
            i = j
            continue
        a, b, sa, sb = p[i], p[j], s[i], s[j]
        room_i, has_i, room_j, has_j = (1 - a) * sa, a * sa, (1 - b) * sb, b * sb
        up, down = min(room_i, has_j), min(has_i, room_j)  # words that can move to i, to j
        if draws[j] * (up + down) < down:
            p[i] = 1.0 if up == room_i else a + up / sa
            p[j] = 0.0 if up == has_j else b - up / sb
        else:
            p[i] = 0.0 if down == has_i else a - down / sa
            p[j] = 1.0 if down == room_j else b + down / sb
        i = i if 0.0 < p[i] < 1.0 else (j if 0.0 < p[j] < 1.0 else -1)
    return np.array(p), i


def passed_on(size: np.ndarray, part: np.ndarray, draw: float) -> bool:
    """Round the fraction ``part[0]`` up or down, by its share, and take the words from the
    fractions after it or give them to these, each by its room; False (nothing done) if they
    have too little room both ways.  If there is room for one only, that one is taken."""
    z, r = size[1:], part[1:]
    open_ = (r > 0) & (r < 1)
    room, held = float((z * (1 - r))[open_].sum()), float((z * r)[open_].sum())
    freed, wanted = float(part[0] * size[0]), float((1 - part[0]) * size[0])  # rounded down, up
    if freed > room and wanted > held:
        return False
    up = draw < part[0] if freed <= room and wanted <= held else wanted <= held
    moved = r - wanted * r / held if up else r + freed * (1 - r) / room
    part[1:] = np.where(open_, np.clip(moved, 0.0, 1.0), r)
    part[0] = 1.0 if up else 0.0
    return True


def settled(size: np.ndarray, part: np.ndarray, draws: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The parts after pivotal rounding by size class of documents ordered long to short: at
    most one is still a fraction.  The sum of ``size * part`` does not change."""
    part, left, low = part.copy(), -1, 0
    for high in [*(np.flatnonzero(np.diff(np.frexp(size)[1])) + 1).tolist(), len(size)]:
        at = np.arange(low, high)
        if left >= 0:  # a longer one for which the shorter ones had too little room
            at = np.concatenate([[left], at])
        part[at], i = pivot(size[at], part[at], draws[at])
        left, low = (int(at[i]) if i >= 0 else -1), high
        if left >= 0 and high < len(size):
            tail = np.concatenate([[left], np.arange(high, len(size))])
            some = part[tail]
            if passed_on(size[tail], some, more[left]):
                part[tail], left = some, -1
    return part


ROW = "doc_id long, source string, size long, rows long, whole int, part double, leaf long"
FRACTION = "part > 0 and part < 1"


def reduce_fractions(rows: DataFrame, leaves: int, seed: int) -> tuple[list[DataFrame], DataFrame]:
    """(settled rows, level by level; the rows that are still a fraction, at most one a
    source) of ``rows`` dealt to at most ``leaves`` leaves a source."""
    def settle(table: pa.Table) -> pa.Table:
        key = splitmix(table.column("doc_id").fill_null(-1).to_numpy().astype(np.uint64) + np.uint64(seed))
        size = (table.column("size").to_numpy() * table.column("rows").to_numpy()).astype(np.float64)
        order = np.lexsort((key, -size))
        part = settled(size[order], table.column("part").to_numpy()[order], _uniform(key, seed), _uniform(key, seed + 1))
        table = table.take(pa.array(order))
        return table.set_column(table.schema.get_field_index("part"), "part", pa.array(part))

    done = []
    while True:
        level = publish(rows.groupBy("source", "leaf").applyInArrow(settle, ROW), "mix-level")
        done.append(level.filter(f"not ({FRACTION})"))
        rows = level.filter(FRACTION)
        if leaves <= 1:
            return done, rows
        leaves = -(-leaves // FAN_IN)
        rows = rows.withColumn("leaf", F.floor(F.col("leaf") / FAN_IN))


def mix_rows(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP,
             leaf_rows: int = LEAF, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row per distinct (doc_id,
    source, size) of ``sizes``.  Repeated rows get the same number of copies (together they
    weigh as one document that is as many times as long)."""
    sizes = publish(sizes, "sizes")
    targets = publish(source_targets(sizes, weights, cap), "targets")
    few = targets.count() <= 100_000
    same = lambda: F.col("s.source").eqNullSafe(F.col("t.source"))
    of_source = lambda df: F.broadcast(df.alias("t")) if few else df.alias("t")
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    leaf = lambda n: F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.greatest(F.lit(1), n))
    leaves, long_leaf = F.ceil(F.col("n") / leaf_rows), LONG * leaf_rows * leaf_rows  # documents behind a leaf of long ones
    # the long ones settle first; the rest of the words is shared by the others, in the next step
    rows = publish(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")).alias("s").join(of_source(targets), same())
                   .withColumn("_x", x)
                   .withColumn("part", F.when(F.col("size") > 0, F.col("_x") - F.floor("_x")).otherwise(F.lit(0.0)))
                   .withColumn("is_long", F.col("size") * F.col("rows") * leaves > F.col("source_size") * F.lit(LONG))
                   .select("doc_id", "s.source", "size", "rows", F.floor("_x").cast("int").alias("whole"), "part",
                           leaf(F.when(F.col("is_long"), F.ceil(F.col("n") / long_leaf)).otherwise(leaves)).alias("leaf"), "is_long"),
                   "mix-rows")
    most = targets.agg(F.max("n")).first()[0] or 0
    long_done, long_left = reduce_fractions(rows.filter("is_long").drop("is_long"), math.ceil(most / long_leaf), seed)
    others = rows.filter("not is_long").drop("is_long")
    held = others.filter(FRACTION).groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.max("part").alias("p"))
    freed, wanted = (share * F.col("size") * F.col("rows") for share in (F.col("part"), 1 - F.col("part")))  # if rounded down, up
    room, has = F.coalesce((1 - F.col("p")) * F.col("words"), F.lit(0.0)), F.coalesce(F.col("p") * F.col("words"), F.lit(0.0))
    draw = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + 2)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    up = (F.when((freed <= room) & (wanted <= has), draw < F.col("part")).when(wanted <= has, True).when(freed <= room, False)
          .otherwise(F.col("part") >= 0.5))
    last = publish(long_left.alias("s").join(held.alias("t"), same(), "left").withColumn("up", up)
                   .withColumn("moved", F.when(F.col("up"), -F.least(wanted, has)).otherwise(F.least(freed, room)) / F.col("words"))
                   .select("doc_id", "s.source", "size", "rows", "whole", F.col("up").cast("double").alias("part"), "leaf", "moved"),
                   "mix-long")
    others = (others.alias("s").join(of_source(last.select("source", "moved")), same(), "left")
              .select("doc_id", "s.source", "size", "rows", "whole",
                      F.when(F.expr(FRACTION), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("part") + F.coalesce("moved", F.lit(0.0)))))
                      .otherwise(F.col("part")).alias("part"), "leaf"))
    done, left = reduce_fractions(others, -(-most // leaf_rows), seed)
    # one fraction per source is left: the nearer whole number keeps the source's words
    # within half of that one document of the target
    left = left.withColumn("part", F.when(F.col("part") >= 0.5, 1.0).otherwise(0.0))
    out = left
    for d in [*long_done, last.drop("moved"), *done]:
        out = out.unionByName(d)
    return (out.alias("s").join(targets.alias("t"), same())
            .select("doc_id", "s.source", "size", "source_size", "target",
                    (F.col("whole") + F.col("part").cast("int")).alias("copies")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, leaf_rows: int = LEAF,
        seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (copies times size) of every document.

    A document without words takes part with no words (its copies are those of its source,
    rounded down).  Null source: a source of its own, ordered last.  Null text: no words.
    Rows with the same doc_id, source and size get the same copies, each a row of the result.
    An empty table gives no rows; extra columns are ignored."""
    sizes = publish(word_counts(docs), "word-counts")
    mixed = mix_rows(sizes, weights, cap, leaf_rows, seed)
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "source", "size")]
    return (sizes.alias("a").join(mixed.alias("b"), keys[0] & keys[1] & keys[2])
            .select("a.doc_id", "a.size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("a.size")).alias("taken")))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP,
                    seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (not at all, once or more)."""
    plain, name = masked(docs)
    sizes = publish(word_counts(docs), "word-counts")
    copies = mix_rows(sizes, weights, cap, seed=seed).filter("copies > 0")

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [Words(buf, offs).counts() for _, _, buf, offs in text_chunks(b.column(name["text"]))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(n) if n else [], pa.int64())],
                                             names=[*b.schema.names, "_words"])

    rows = plain.mapInArrow(sized, extended(plain, _words="long"))
    same = (F.col(f"a.{name['doc_id']}").eqNullSafe(F.col("b.doc_id"))
            & F.col(f"a.{name['source']}").eqNullSafe(F.col("b.source")) & (F.col("a._words") == F.col("b.size")))
    return (rows.alias("a").join(copies.alias("b"), same)
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select(*[f"a.{c}" for c in plain.columns]).toDF(*docs.columns))
