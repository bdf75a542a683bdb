"""Best-fit packing of token pieces into sequences under several capacities.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared
piece lengths).  A piece goes into the open sequence that fits it under every capacity and
scores best: by the weighted dot product of its demand and what the sequence has left
(``score="dot"``), or by the weighted norm of what would be left (``score="norm"``; smaller
is better).  If none fits, a new one is opened.

Pieces are dealt to groups of bounded size by a hash of (document, piece, place in its
batch), so no key gathers in one task, and each group packs its pieces longest first.  The
sequences that a round leaves badly filled are opened again and their pieces dealt anew to
fewer groups, until one group takes all that is left (or ``max_rounds``).  With thousands of
pieces in a group a round wastes next to nothing, so few sequences are opened again."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import publish
from .tokenizers_cached import WordIds, loaded, vocabulary

MAX_TOKENS = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
GROUP_PIECES = 8192  # pieces of a packing group, on average
MAX_ROUNDS = 4
OPEN_BELOW = 0.98  # a sequence filled less than this is packed again in the next round

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


def cut_pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS, vocabulary_file: str | None = None,
               end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document's ids (text ids, then ``end_id``); only documents
    longer than ``max_tokens`` have more than one.  A null text is empty, so its only id is
    the end."""
    path = vocabulary_file or vocabulary(VOCABULARY)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(WordIds, path)
        seen = 0
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = coder.encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at:at + 4 * max_tokens]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), seen))
                    seen += 1
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x % 65536 for x in c] if i == 5 else c, k)
                 for i, (c, k) in enumerate(zip(cols, kinds))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA)


def pack_group(length: np.ndarray, capacity: tuple[float, float, float],
               weights: tuple[float, float, float] = (1.0, 0.25, 0.5), score: str = "dot"
               ) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece of one group.  Longest first; equal lengths in the
    given order."""
    demand = np.stack([length, np.ones(len(length)), np.square(length, dtype=np.float64)], 1) / np.array(capacity)
    w = np.array(weights)
    left = np.ones((len(length) + 1, 3))
    used = np.zeros(len(length) + 1, np.int64)
    seq, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    lo = n = 0  # sequences below lo are full
    smallest = demand[:, 0].min() if len(demand) else 0
    for i in np.argsort(-length, kind="stable"):
        d = demand[i]
        while lo < n and left[lo, 0] < smallest - 1e-12:
            lo += 1
        room = left[lo:n] - d
        fits = np.flatnonzero((room >= -1e-12).all(axis=1))
        if len(fits):
            if score == "dot":  # the tightest: demand against what is left, least first
                best = fits[np.argmin(left[lo:n][fits] @ (w * d))]
            else:
                best = fits[np.argmin(np.square(room[fits]) @ w)]
            j = lo + best
        else:
            j, n = n, n + 1
        left[j] -= d
        seq[i], offset[i] = j, used[j]
        used[j] += length[i]
    return seq, offset


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, max_docs: int = MAX_TOKENS,
         max_attention: float = float(MAX_TOKENS) ** 2, score: str = "dot",
         group_pieces: int = GROUP_PIECES, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``pieces`` plus sequence_id and offset.  With the default document and attention
    capacities the token capacity alone binds.  A piece longer than a capacity allows gets a
    sequence of its own."""
    spark = pieces.sparkSession
    todo = publish(pieces, "pieces")
    columns = [c for c in todo.columns if c != "salt"]
    done: list[DataFrame] = []
    for turn in range(max_rounds):
        n = todo.count()
        groups = max(1, -(-n // group_pieces))
        last = groups == 1 or turn == max_rounds - 1

        def pack_table(table: pa.Table) -> pa.Table:
            table = table.sort_by([("length", "descending"), ("doc_id", "ascending"),
                                   ("piece", "ascending"), ("salt", "ascending")])
            length = table.column("length").to_numpy()
            seq, offset = pack_group(length, (max_tokens, max_docs, max_attention), score=score)
            fill = np.bincount(seq, weights=length) / max_tokens
            name = (turn << 56) + table.column("_group").to_numpy().astype(np.int64) * (1 << 24) + seq
            table = table.drop_columns("_group")
            return (table.append_column("sequence_id", pa.array(name)).append_column("offset", pa.array(offset))
                    .append_column("open", pa.array(fill[seq] < OPEN_BELOW)))

        schema = PIECE_SCHEMA + ", sequence_id long, `offset` long, `open` boolean"
        dealt = todo.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "salt", F.lit(turn)),
                                                 F.lit(groups)).cast("int"))
        packed = publish(dealt.groupBy("_group").applyInArrow(pack_table, schema), f"packed{turn}")
        done.append(packed if last else packed.filter(~F.col("open")))
        if last:
            break
        todo = packed.filter("open").select(*columns, "salt")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of
    every document.  Null or empty text: one piece with the end id.  Repeated rows are packed
    each; an empty table gives no rows; extra columns are ignored."""
    return pack(cut_pieces(docs, max_tokens), max_tokens, **options)
