"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the ``k`` smallest distinct 64-bit hashes of a text's shingles (five
consecutive words, A-Z lower-cased; a shorter text is one shingle; a text without words has
the empty sketch).  Sketches of parts merge into the sketch of the whole (the k smallest of
the union), and estimate the number of distinct shingles, resemblance and containment.  A
text with fewer than ``k`` shingles is represented exactly.

``fingerprint_edits`` needs each document's neighbour in descending id order.  Ids are cut
into blocks at quantiles; every block also gets the first document of the block that follows
it (round to the first block at the end), so each block is worked through on its own in one
sorted pass, and the texts are shuffled once."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, Words, extended, joined, shingle_sets, text_chunks

K = 128
SHINGLE = 5
BLOCK_ROWS = 2048  # documents of a block, at least
MAX_BLOCKS = 20_000  # block borders that the driver holds, at most


# ---- sketches in numpy ---------------------------------------------------------------------

def sketches(buf: np.ndarray, offs: np.ndarray, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    words = Words(LOWER[buf], offs)
    return [s[:k] for s in shingle_sets(words, words.hashes(), shingle)]


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(text: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text or ""), "<u8")


def merge(sketch_list: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of the texts behind the sketches."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *sketch_list]))[:k]


def distinct_shingles(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles (exact below ``k``)."""
    if len(sketch) < k:
        return float(len(sketch))
    return (k - 1) / ((float(sketch[k - 1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A & B| / |A | B|: the share of the union's k smallest hashes that both
    sketches hold.  Two empty sketches: 1."""
    union = merge([a, b], k)
    if len(union) == 0:
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(np.isin(both, union, assume_unique=True))) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A & B| / |A|; 1 for an empty A."""
    if len(a) == 0:
        return 1.0
    shared = resemblance(a, b, k) * distinct_shingles(merge([a, b], k), k)
    return min(1.0, shared / distinct_shingles(a, k))


# ---- on Spark ------------------------------------------------------------------------------

def fingerprint(docs: DataFrame, text: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` plus ``fingerprint`` and ``n_shingles`` (estimated); a null text counts as
    empty.  One pass without a shuffle.  Columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("fingerprint", "n_shingles")]
    schema = extended(docs.select(*keep), fingerprint="string", n_shingles="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [s for _, _, buf, offs in text_chunks(batch.column(text))
                      for s in sketches(buf, offs, k, shingle)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([encode(s) for s in prints], pa.string()),
                 pa.array([distinct_shingles(s, k) for s in prints], pa.float64())],
                names=[*batch.schema.names, "fingerprint", "n_shingles"])

    return docs.select(*keep).mapInArrow(run, schema)


def merge_by(prints: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """The merged fingerprint per key.  Each task merges what it holds first, so a key with
    a third of all rows sends one sketch per task to its group."""
    schema = prints.select(*keys, "fingerprint").schema

    def partial(frames):
        for frame in frames:
            groups = frame.groupby(keys, dropna=False)["fingerprint"]
            yield groups.agg(lambda x: encode(merge([decode(v) for v in x], k))).reset_index()

    def final(frame):
        row = frame.iloc[[0]].copy()
        row["fingerprint"] = encode(merge([decode(v) for v in frame["fingerprint"]], k))
        return row

    return (prints.select(*keys, "fingerprint").mapInPandas(partial, schema)
            .groupBy(*keys).applyInPandas(final, schema))


def _dealt(docs: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """The rows with their block and, as a guest (``_guest`` 1), the top row of each block in the
    one above; and the number of blocks.  Blocks are ranges of (id, text hash): an id that fills
    several blocks has as many equal quantiles, and its hashes are dealt evenly to them."""
    low = F.lit(-(1 << 63)).cast("long")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), low).alias("_ord"),
                       F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    n = rows.count()
    blocks = max(1, min(MAX_BLOCKS, -(-n // block_rows)))
    found: list[float] = []
    if blocks > 1:
        found = rows.approxQuantile("_ord", [i / blocks for i in range(1, blocks)], 0.2 / blocks)
    cuts = np.array(sorted(int(x) for x in found), np.int64)

    def block(ord_: np.ndarray, h: np.ndarray) -> np.ndarray:
        left = np.searchsorted(cuts, ord_, side="left")
        parts = (np.searchsorted(cuts, ord_, side="right") - left).astype(np.uint64)
        high = (h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        return (left + ((high * parts) >> np.uint64(32)).astype(np.int64)).astype(np.int32)

    def keys(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return b.column("_ord").to_numpy(zero_copy_only=False), b.column("_h").to_numpy(zero_copy_only=False)

    def block_of(frames):
        for b in frames:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block(*keys(b)))], names=[*b.schema.names, "_block"])

    blocked = rows.select("_ord", "_h").mapInArrow(block_of, "_ord long, _h long, _block int")
    tops = sorted((r["_block"], r["_top"]["_ord"], r["_top"]["_h"]) for r in
                  blocked.groupBy("_block").agg(F.max(F.struct("_ord", "_h")).alias("_top")).collect())
    if not tops:
        tops = [(0, 0, 0)]
    # the top document of each block is the next one for the lowest document of the block above
    at_top = {block: (ord_, h, tops[(i + 1) % len(tops)][0]) for i, (block, ord_, h) in enumerate(tops)}
    top_ord, top_h, into = (np.zeros(tops[-1][0] + 1, t) for t in (np.int64, np.int64, np.int32))
    for k, v in at_top.items():
        top_ord[k], top_h[k], into[k] = v

    def deal(frames):
        for b in frames:
            ord_, h = keys(b)
            at = block(ord_, h)
            top = np.flatnonzero((top_ord[at] == ord_) & (top_h[at] == h))
            texts = b.column("text").take(pa.array(top)).to_pylist()
            extra = np.array(sorted({(at[r], t): r for r, t in zip(top, texts)}.values()), np.int64)  # equal rows once
            pick = np.concatenate([np.arange(len(ord_)), extra])
            flag = np.zeros(len(pick), np.int32)
            flag[len(ord_):] = 1
            out = b.take(pa.array(pick))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(np.concatenate([at, into[at[extra]]])), pa.array(flag)],
                names=[*out.schema.names, "_block", "_guest"])

    return rows.mapInArrow(deal, extended(rows, _block="int", _guest="int")), int(tops[-1][0]) + 1


def fingerprint_edits(docs: DataFrame, k: int = K, shingle: int = SHINGLE,
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to the edited
    text and to the next document.

    The edited text has the last ``floor(n / 2)`` of the text's ``n`` code points replaced by
    the first as many (or all) of the next document in descending ``doc_id`` order (after
    the last: the first).  Null text: empty.  Rows with one doc_id follow each other by
    their text's hash, descending (one id may fill many blocks; only rows equal in id and text
    stay in one task); a null doc_id comes after all others; a single row is
    its own next document; an empty table gives no rows.  Extra columns are ignored."""
    dealt, blocks = _dealt(docs, block_rows)
    laid = (dealt.repartitionById(blocks, "_block")
            .sortWithinPartitions("_block", "_guest", F.desc("_ord"), F.desc("_h"), F.desc("text")))

    def run(batches):
        held: list[tuple] = []  # rows whose next document has not come yet

        def flush(last):
            yield _edited_batch(held, last, k, shingle)
            held.clear()

        size, done = 0, False
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(3)]
            for doc_id, text, guest in zip(cols[0], cols[1], cols[2]):
                if done:
                    continue
                if guest:
                    done = True
                    if held:
                        yield from flush(text)
                    continue
                if size > CHUNK_BYTES and held:
                    yield from flush(text)
                    size = 0
                held.append((doc_id, text))
                size += len(text)
        if held:  # every block has a guest; kept for safety
            yield from flush(held[0][1])

    return laid.select("doc_id", "text", "_guest").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")


def _edited_batch(rows: list[tuple], after: str, k: int, shingle: int) -> pa.RecordBatch:
    texts = [t for _, t in rows] + [after]
    sizes = [len(t) for t in texts[:-1]]
    edited = [(t[:n - n // 2] + nxt[:n // 2]).encode() for t, nxt, n in zip(texts, texts[1:], sizes)]
    own = _in_chunks([t.encode() for t in texts], k, shingle)
    new = _in_chunks(edited, k, shingle)
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int64()), pa.array(sizes, pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        pa.array([encode(s) for s in own[:-1]], pa.string()),
        pa.array([encode(s) for s in new], pa.string()),
        pa.array([resemblance(a, b, k) for a, b in zip(own, new)], pa.float64()),
        pa.array([resemblance(a, b, k) for a, b in zip(own, own[1:])], pa.float64()),
    ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
              "near_edited", "near_next"])


def _in_chunks(texts: list[bytes], k: int, shingle: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for t in texts:
        if part and size + len(t) > CHUNK_BYTES:
            out += sketches(*joined(part), k, shingle)
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        out += sketches(*joined(part), k, shingle)
    return out
