"""Generic building blocks shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def publish(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the cluster's shared checkpoint folder and read it back: later
    jobs neither recompute it nor depend on the executors that made it, and its size is known
    when they are planned, so a small one is broadcast and a large one is not."""
    from ..session import checkpoint_dir

    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with one more column that is evaluated once a row: filters and projections above
    can't repeat it, as they do with a plain expression (nor can they drop it)."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _digest(columns: list[str], part: int) -> Column:
    """Half of a 128-bit digest of some columns; a null differs from every value and from
    nulls of other columns."""
    return F.xxhash64(F.lit(part), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def repeated_keys(df: DataFrame, keys: list[str], ord_col: str = "ord") -> DataFrame:
    """(k1, k2, last, ties): the digests of the keys that more than one row has, their greatest
    ``ord`` and how many rows have that.  Hash aggregates over fixed-width columns, combined
    before each shuffle."""
    narrow = df.select(_digest(keys, 1).alias("k1"), _digest(keys, 2).alias("k2"), F.col(ord_col).alias("o"))
    counts = narrow.groupBy("k1", "k2", "o").agg(F.count("*").alias("c"))
    return (counts.groupBy("k1", "k2")
            .agg(F.max("o").alias("last"), F.sum("c").alias("n"), F.coalesce(F.max_by("c", "o"), F.sum("c")).alias("ties"))
            .filter("n > 1").drop("n"))


def keep_last(df: DataFrame, keys: list[str], ord_col: str = "ord") -> DataFrame:
    """Keep, per key combination, the row with the greatest ``ord`` (pandas
    ``drop_duplicates(keep='last')`` on a frame ordered by ``ord``).  NULL keys compare
    equal, as in pandas, and a NULL ``ord`` is the smallest.  ``ord`` stands for the row position;
    among rows of a key that share the greatest ``ord`` the one with the greatest other columns
    stays, so every key keeps exactly one row and the layout of the data decides nothing.

    Two passes.  The first, over fixed-width columns only, finds the keys that repeat and their
    greatest ``ord``, and publishes them (digests of 128 bits stand for the keys).  The second
    drops the other rows of these keys where they lie: rows are shuffled only if the published
    table is too large to be broadcast.  A key holding a third of all rows is one row of it."""
    repeated = publish(repeated_keys(df, keys, ord_col), "repeated-keys")
    found = repeated.agg(F.count("*").alias("n"), F.max("ties").alias("ties")).first()
    if not found["n"]:
        return df
    names = {"k1": "_k1", "k2": "_k2", "last": "_last", "ties": "_ties"}
    marked = (df.withColumns({"_k1": _digest(keys, 1), "_k2": _digest(keys, 2)})
              .join(repeated.withColumnsRenamed(names), ["_k1", "_k2"], "left"))
    winners = marked.filter(F.col("_ties").isNull() | F.col(ord_col).eqNullSafe(F.col("_last")))
    if found["ties"] == 1:
        return winners.select(*df.columns)
    others = [c for c in df.columns if c != ord_col]
    alone = winners.filter(F.coalesce("_ties", F.lit(1)) == 1).select(*df.columns)
    tied = winners.filter("_ties > 1").groupBy("_k1", "_k2").agg(F.max(F.struct(ord_col, *others)).alias("_row"))
    return alone.unionByName(tied.select(*[F.col("_row")[c].alias(c) for c in df.columns]))


DIGIT_BITS = 16


def nth_smallest(values: DataFrame, n: DataFrame) -> DataFrame:
    """One row (cut): the ``n``-th smallest value of the one bigint column of ``values``;
    no row if there are fewer.  ``n`` is a frame of one row and column.

    A radix selection: counts by the leading 16 bits tell which of them the value has and how
    many are below; then the same among those, by the next 16 bits, and so on.  Each step is
    one aggregate over the narrow column (at most 2^16 groups); nothing is sorted, and no job
    runs until the result is asked for."""
    flipped = F.col(values.columns[0]).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    keys = values.select(flipped.alias("key"))
    state = n.select(F.lit(0).cast("bigint").alias("prefix"), F.col(n.columns[0]).cast("bigint").alias("wanted"))
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        high = F.shiftrightunsigned("key", shift + DIGIT_BITS) if shift + DIGIT_BITS < 64 else F.lit(0).cast("bigint")
        digit = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        counts = (keys.select(high.alias("prefix"), digit.alias("digit")).join(F.broadcast(state), "prefix")  # one row
                  .groupBy("prefix", "wanted", "digit").agg(F.count("*").alias("c")))
        before = F.sum("c").over(Window.partitionBy("prefix", "wanted").orderBy("digit")) - F.col("c")
        state = (counts.withColumn("before", before)
                 .filter((F.col("before") < F.col("wanted")) & (F.col("before") + F.col("c") >= F.col("wanted")))
                 .select(F.shiftleft("prefix", DIGIT_BITS).bitwiseOR(F.col("digit")).alias("prefix"),
                         (F.col("wanted") - F.col("before")).alias("wanted")))
    return state.select(F.col("prefix").bitwiseXOR(F.lit(-(1 << 63))).alias("cut"))


def head_by(df: DataFrame, n: int | DataFrame | None, order_col: str = "ord",
            values: DataFrame | None = None) -> DataFrame:
    """The first ``n`` rows by ``order_col`` (unique, bigint): one path for every ``n``, a
    number or a frame of one row.  None: all rows.  ``values`` may give the column of ``df``
    by a cheaper way."""
    if n is None:
        return df
    if isinstance(n, int):
        n = df.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("n"))
    values = df if values is None else values
    cut = nth_smallest(values.select(F.col(order_col).cast("bigint").alias("v")), n).scalar()
    return df.filter((n.scalar() > 0) & (F.col(order_col) <= F.coalesce(cut, F.lit((1 << 63) - 1))))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and continue from there,
    so a lost executor does not send the job back through an expensive lineage.  The folder
    is ``spark.checkpoint.dir`` (never a machine-local path on a cluster)."""
    from ..session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for joins that must not broadcast it: found pairs and texts, whose size Spark takes
    from the compressed files they come from (a checkpoint keeps that guess), so that a side
    of gigabytes would pass whole through the driver."""
    return df.hint("merge")
