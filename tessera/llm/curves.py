"""Nearest neighbours by shifted space-filling curves.

Vectors are projected onto a few random orthonormal directions (another set, and another
shift, for every curve), quantised and ordered by their Hilbert key.  Each curve's order is
cut into blocks at quantiles of the key; a query meets the rows within ``WINDOW`` places on
either side (in its block and the two next to it), and the union over the curves is ranked
by the exact distance.

That alone finds most neighbours of clustered vectors but few of vectors that fill all
dimensions evenly (the README has figures), so the search is then completed: a block's
bounding box in the projected space bounds its rows' distances from below (a projection
never lengthens a distance), and a query also meets every block that may hold a row nearer
than its tenth one so far, in tasks of bounded size (a block of rows, a chunk of queries).
The result is exact; the curves decide how much is left to do.

The fit (ranges of the projected coordinates) uses at most ``SAMPLE`` vectors; every vector
is indexed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import publish

K = 10
CURVES = 3
DIMS = 8  # projected dimensions
BITS = 6  # per dimension; a key has DIMS * BITS = 48 bits
WINDOW = 64
BLOCK = 4096  # rows of a block, on average
CHUNK = 4096  # queries of a chunk, on average
MAX_BLOCKS = 20_000  # whose boxes are broadcast; larger tables get larger blocks
SAMPLE = 2000


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The position along the Hilbert curve of each row of integer coordinates below
    ``2**bits``: Gray-code reflection from the highest bit down, then interleaved bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """The projections, shifts and ranges of all curves, fitted on a sample."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, seed: int = 11):
        rng = np.random.Generator(np.random.Philox(seed))
        d = sample.shape[1]
        dims = min(DIMS, d)
        self.axes, self.low, self.step = [], [], []
        for _ in range(curves):
            axes = np.linalg.qr(rng.normal(size=(d, dims)))[0]
            p = sample @ axes
            low, high = p.min(0), p.max(0)
            span = np.maximum(high - low, 1e-12) * 1.25
            self.axes.append(axes)
            self.low.append(low - span * 0.2 * rng.random(dims))  # the shift
            self.step.append(span / (1 << BITS))

    def project(self, x: np.ndarray, curve: int) -> np.ndarray:
        return x @ self.axes[curve]

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        cells = np.floor((self.project(x, curve) - self.low[curve]) / self.step[curve])
        return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _blocks(key: np.ndarray, ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The block of each row; a key that spans several quantiles spreads over their blocks."""
    lo, hi = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
    return lo + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % (hi - lo + 1)


def _nearest(q_ids, q, ids, x, k, limit=None):
    """(query position, row position, distance) of each query's ``k`` nearest rows other than
    itself, exact, ties to smaller ids; those beyond ``limit`` are left out."""
    out = ([], [], [])
    squares = (x * x).sum(1)
    for a in range(0, len(q), 256):
        part = q[a:a + 256]
        rough = (part * part).sum(1)[:, None] + squares - 2 * (part @ x.T)
        slack = 1e-9 * (squares.max() + (part * part).sum(1).max() + 1e-300)
        rough[q_ids[a:a + 256, None] == ids[None, :]] = np.inf
        kth = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        for i, bound in enumerate(kth):
            if limit is not None:
                bound = min(bound, limit[a + i] ** 2)
            at = np.flatnonzero(rough[i] <= bound + slack) if np.isfinite(bound) else np.flatnonzero(np.isfinite(rough[i]))
            diff = x[at] - part[i]
            dist = np.sqrt((diff * diff).sum(1))
            at, dist = (y[np.lexsort((ids[at], dist))[:k]] for y in (at, dist))
            out[0].append(np.full(len(at), a + i))
            out[1].append(at)
            out[2].append(dist)
    return tuple(np.concatenate(o) if o else np.empty(0, np.int64) for o in out)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, embedding (double): one row per id (repeated ids: the smallest array), without
    null ids, null or zero vectors, vectors with null or non-finite components, and vectors
    of another length than the most frequent one (ties: the shorter)."""
    v = F.col("embedding")
    good = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
            .filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
            .filter(F.exists(v, lambda x: x != 0)))
    lengths = good.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if lengths:
        good = good.filter(F.size(v) == lengths[0]["d"])
    return good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


RESULT = "query_id long, vec_id long, score double"


def search(vectors: DataFrame, is_query=None, k: int = K, curves: int = CURVES, window: int = WINDOW,
           block_rows: int = BLOCK, chunk_rows: int = CHUNK, complete: bool = True) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of each query's ``k``
    nearest other rows; fewer if there are fewer.  ``is_query`` is a condition on vec_id
    (default: divisible by 100).  ``complete=False`` stops after the curves' windows."""
    spark = vectors.sparkSession
    is_query = F.col("vec_id") % 100 == 0 if is_query is None else is_query
    rows = publish(usable(vectors), "vectors")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = Curves(np.array([r["embedding"] for r in sample]), curves)
    key_cols = [f"k{c}" for c in range(curves)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("embedding"))
            keys = [pa.array(fitted.keys(x, c)) if len(x) else pa.array([], pa.int64()) for c in range(curves)]
            yield pa.RecordBatch.from_arrays([*b.columns, *keys], names=["vec_id", "embedding", "is_query", *key_cols])

    rows = publish(rows.withColumn("is_query", is_query).mapInArrow(
        keyed, "vec_id long, embedding array<double>, is_query boolean, " + ", ".join(f"{c} long" for c in key_cols)), "curve-keys")
    blocks = max(1, min(MAX_BLOCKS, -(-n // block_rows)))
    if blocks > 1:
        probs = [i / blocks for i in range(1, blocks)]
        cuts = [np.array(c, np.int64) for c in rows.approxQuantile(key_cols, probs, 0.2 / blocks)]
    else:
        cuts = [np.empty(0, np.int64)] * curves

    # ---- windows along every curve
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            asks = np.flatnonzero(b.column("is_query").to_numpy(zero_copy_only=False))
            for c in range(curves):
                key = b.column(key_cols[c]).to_numpy()
                own = _blocks(key, ids, cuts[c])
                cells, picks, asking = [own], [np.arange(len(ids))], [np.zeros(len(ids), bool)]
                for step in (-1, 0, 1):
                    to = own[asks] + step
                    ok = (to >= 0) & (to < blocks)
                    cells.append(to[ok])
                    picks.append(asks[ok])
                    asking.append(np.ones(ok.sum(), bool))
                pick = np.concatenate(picks)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(cells) * curves + c), pa.array(np.concatenate(asking)), pa.array(key[pick]),
                    pa.array(ids[pick]), b.column("embedding").take(pa.array(pick))],
                    names=["cell", "asks", "key", "vec_id", "embedding"])

    def near(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        key, ids, x = table.column("key").to_numpy(), table.column("vec_id").to_numpy(), _matrix(table.column("embedding"))
        data, q = np.flatnonzero(~asks), np.flatnonzero(asks)
        data = data[np.lexsort((ids[data], key[data]))]
        spots = np.searchsorted(key[data], key[q])
        found = ([], [], [])
        for i, s in zip(q, spots):
            part = data[max(0, s - window):s + window]
            if len(part):
                _, at, dist = _nearest(ids[i:i + 1], x[i:i + 1], ids[part], x[part], k)
                found[0].append(np.full(len(at), ids[i]))
                found[1].append(ids[part][at])
                found[2].append(dist)
        a, b, s = (np.concatenate(f) if f else np.empty(0) for f in found)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    dealt = rows.mapInArrow(deal, "cell long, asks boolean, key long, vec_id long, embedding array<double>")
    first = publish(_best(dealt.groupBy("cell").applyInArrow(near, RESULT), k), "curve-windows")
    if not complete:
        return _ranked(first)

    # ---- the blocks that the bounds can't exclude
    axes = fitted.axes[0]

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            own = _blocks(b.column("k0").to_numpy(), ids, cuts[0])
            yield pa.RecordBatch.from_arrays([pa.array(own), *b.columns], names=["block", *b.schema.names])

    placed = rows.mapInArrow(boxed, "block long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, block = _matrix(b.column("embedding")) @ axes, b.column("block").to_numpy()
            u, at = np.unique(block, return_inverse=True)
            low, high = np.full((len(u), p.shape[1]), np.inf), np.full((len(u), p.shape[1]), -np.inf)
            np.minimum.at(low, at, p)
            np.maximum.at(high, at, p)
            m, d = low.shape
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(u, d)), pa.array(np.tile(np.arange(d), m)), pa.array(low.ravel()), pa.array(high.ravel())],
                names=["block", "axis", "low", "high"])

    boxes = (placed.mapInArrow(sides, "block long, axis long, low double, high double")
             .groupBy("block", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas())  # <= MAX_BLOCKS
    low, high = (boxes.pivot(index="block", columns="axis", values=c) for c in ("low", "high"))
    names, low, high = low.index.to_numpy(), low.to_numpy(), high.to_numpy()
    queries = rows.filter("is_query").select("vec_id", "embedding")
    chunks = max(1, -(-queries.count() // chunk_rows))
    limits = first.groupBy("query_id").agg(F.count("*").alias("got"), F.max("score").alias("worst"))
    asked = (queries.join(limits, queries.vec_id == limits.query_id, "left")
             .select("vec_id", "embedding", F.when(F.col("got") >= k, F.col("worst")).otherwise(float("inf")).alias("bound"),
                     F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, bound = _matrix(b.column("embedding")) @ axes, b.column("bound").to_numpy()
            for i in range(len(bound)):
                gap = np.maximum(np.maximum(low - p[i], p[i] - high), 0)
                to = names[np.sqrt((gap * gap).sum(1)) <= bound[i] * (1 + 1e-9) + 1e-12]
                pick = pa.array(np.full(len(to), i))
                yield pa.RecordBatch.from_arrays([pa.array(to), *(c.take(pick) for c in b.columns)],
                                                 names=["block", *b.schema.names])

    open_ = asked.mapInArrow(spread, "block long, vec_id long, embedding array<double>, bound double, chunk long")
    pairs = open_.select("block", "chunk").distinct().toDF("data_block", "data_chunk")
    data = (placed.join(pairs, F.col("block") == F.col("data_block"))
            .select("data_block", "data_chunk", "vec_id", "embedding"))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        if len(q_ids) and len(ids):
            i, j, dist = _nearest(q_ids, _matrix(left.column("embedding")), ids, _matrix(right.column("embedding")), k,
                                  left.column("bound").to_numpy())
        else:
            i, j, dist = (np.empty(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(q_ids[i], pa.int64()), "vec_id": pa.array(ids[j], pa.int64()),
                         "score": pa.array(dist, pa.float64())})

    rest = open_.groupBy("block", "chunk").cogroup(data.groupBy("data_block", "data_chunk")).applyInArrow(finish, RESULT)
    return _ranked(_best(first.unionByName(rest), k))


def _best(found: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` best rows, every row once."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def _ranked(best: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.select("query_id", F.row_number().over(order).cast("int").alias("rank"), "vec_id", "score")
