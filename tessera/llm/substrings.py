"""Substring dedup: removing word windows that also start in an earlier document, by suffix
automata of reference shards.

A window is 13 consecutive words.  Equal windows are brought together by content: a window's
anchor is the smallest hash among its nine 5-word grams, and consecutive windows with one
anchor place form a segment (at most nine windows, 21 words).

1. All anchors are counted (per batch, then on the cluster); those of one document only are
   done.  The others go into a Bloom filter whose size is bounded (``MAX_FILTER_BITS``);
   what it lets through by mistake costs time, not correctness.
2. The segments at shared anchors are dealt to shards by anchor, every distinct one with the
   smallest and largest document that has it.  In a shard, an anchor's segments come in the
   order of their first documents: each is streamed through the suffix automaton of the
   segments of smaller documents, whose matching statistics tell which of its windows occur
   there, and is then added to the automaton.
3. A document's window is covered if its segment occurs in a smaller document, or if the
   document is its segment's first and the automaton matched the window.  Words covered by
   such windows are removed.

Anchors that very many documents share (a common line or passage with changing surroundings)
are split: their windows are segments of their own, dealt by their own hash, so no shard
gathers them.  There are at most ``MAX_HOT`` such anchors by construction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, Words, _powers, extended, masked, mix, publish, shuffle_partitions, text_chunks, window_hashes

WINDOW = 13
GRAM = 5
HOT = 2000  # documents from which an anchor is split
MAX_HOT = 50_000  # split anchors, at most: one per this share of all anchor uses
MAX_FILTER_BITS = 1 << 29
FILTER_BLOCKS = 1024
LAST = (1 << 63) - 1  # stands for a null doc_id: after all others


# ---- suffix automata -----------------------------------------------------------------------

class SuffixAutomaton:
    """All word runs of the sequences added so far (none runs across two sequences)."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def _state(self, size: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, c, q: int) -> int:
        """A copy of ``q`` for the runs no longer than those of ``p`` followed by ``c``."""
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
                continue
            new = self._state(self.size[last] + 1, {}, 0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
            last = new

    def matches(self, sequence) -> list[int]:
        """Matching statistics: for each place the length of the longest run ending there
        that occurs in a sequence added before."""
        out, at, n = [], 0, 0
        for c in sequence:
            while at and c not in self.next[at]:
                at = self.link[at]
                n = self.size[at]
            if c in self.next[at]:
                at = self.next[at][c]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


# ---- segments ------------------------------------------------------------------------------

class Segments:
    """The segments of the texts of a chunk: ``anchor``, ``first`` (window) and ``count``
    (windows), ``doc`` (text number), ``word`` (number of the first word within its text)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        self.words = words = Words(buf, offs)
        self.h = h = words.hashes()
        self.window = window
        n = len(words)
        none = np.empty(0, np.int64)
        if n < window:
            self.anchor, self.first, self.count, self.doc = none.view(np.uint64), none, none, none
            self.word = none
            return
        grams = np.full(n, np.uint64(2**64 - 1))
        values, at = window_hashes(words, h, gram)
        grams[at] = values
        starts = np.flatnonzero(words.doc[:n - window + 1] == words.doc[window - 1:])
        reach = window - gram + 1
        view = np.lib.stride_tricks.sliding_window_view(grams, reach)[starts]
        place = starts + view.argmin(axis=1)
        new = np.ones(len(starts), bool)
        new[1:] = place[1:] != place[:-1]
        run = np.flatnonzero(new)
        self.first = starts[run]
        self.count = np.diff(np.append(run, len(starts)))
        self.anchor = grams[place[run]]
        self.doc = words.doc[self.first]
        self.word = self.first - words.first[self.doc]

    def split(self, hot: np.ndarray) -> None:
        """Make every window at a hot anchor a segment of its own, anchored by its hash."""
        if not len(hot) or not len(self.anchor):
            return
        is_hot = np.isin(self.anchor, hot)
        if not is_hot.any():
            return
        at = np.flatnonzero(is_hot)
        first = np.concatenate([np.arange(f, f + c) for f, c in zip(self.first[at], self.count[at])])
        total = np.zeros(len(first), np.uint64)
        for j in range(self.window):
            total += self.h[first + j] * mix(np.array([j + 1], np.uint64))[0]
        doc = self.words.doc[first]
        cold = ~is_hot
        self.anchor = np.concatenate([self.anchor[cold], mix(total)])
        self.first = np.concatenate([self.first[cold], first])
        self.count = np.concatenate([self.count[cold], np.ones(len(first), np.int64)])
        self.doc = np.concatenate([self.doc[cold], doc])
        self.word = np.concatenate([self.word[cold], first - self.words.first[doc]])

    def keep(self, mask: np.ndarray) -> None:
        for name in ("anchor", "first", "count", "doc", "word"):
            setattr(self, name, getattr(self, name)[mask])

    def keys(self) -> np.ndarray:
        """A 64-bit hash of each segment's words (and anchor)."""
        power, inverse = _powers(len(self.h) + 1)
        total = np.zeros(len(self.h) + 1, np.uint64)
        np.cumsum(self.h * power[:len(self.h)], out=total[1:])
        end = self.first + self.count + self.window - 1
        return mix((total[end] - total[self.first]) * inverse[self.first] + mix(self.anchor) * BASE)

    def text(self, i: int) -> bytes:
        """The segment's words joined by one space."""
        w, a = self.words, self.first[i]
        b = a + self.count[i] + self.window - 1
        return b" ".join(w.buf[s:e].tobytes() for s, e in zip(w.start[a:b], w.end[a:b]))


# ---- which anchors matter ------------------------------------------------------------------

class AnchorFilter:
    """A Bloom filter in blocks (the anchor's top bits choose the block, three more hashes
    the bits)."""

    def __init__(self, bits: int, blocks: np.ndarray):
        self.per = bits // FILTER_BLOCKS
        self.table = blocks  # uint8 [FILTER_BLOCKS, per / 8]

    @staticmethod
    def spots(anchor: np.ndarray, per: int) -> Iterator[np.ndarray]:
        x = mix(anchor + np.uint64(0x2545F4914F6CDD1D))
        for shift in (0, 21, 42):
            yield ((x >> np.uint64(shift)) % np.uint64(per)).astype(np.int64)

    def has(self, anchor: np.ndarray) -> np.ndarray:
        block = (anchor >> np.uint64(54)).astype(np.int64)
        out = np.ones(len(anchor), bool)
        for s in self.spots(anchor, self.per):
            out &= (self.table[block, s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
        return out


def shared_anchors(rows: DataFrame) -> DataFrame:
    """(anchor, n): the anchors of more than one document, and of about how many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("_id").to_numpy()
            anchors, docs = [], []
            for at, _, buf, offs in text_chunks(b.column("text")):
                s = Segments(buf, offs)
                anchors.append(s.anchor)
                docs.append(ids[at + s.doc])
            if not anchors:
                continue
            a, d = np.concatenate(anchors), np.concatenate(docs)
            order = np.lexsort((d, a))
            a, d = a[order], d[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
            a, d = a[new], d[new]
            at = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(a[at].view(np.int64)), pa.array(d[at]), pa.array(d[np.append(at[1:], len(a)) - 1] if len(a) else d),
                pa.array(np.diff(np.append(at, len(a))))], names=["anchor", "low", "high", "n"])

    return (rows.mapInArrow(run, "anchor long, low long, high long, n long").groupBy("anchor")
            .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
            .filter("low < high").select("anchor", "n"))


def anchor_filter(anchors: DataFrame) -> tuple[AnchorFilter, np.ndarray]:
    """The filter of all shared anchors and the hot ones (sorted)."""
    total = anchors.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    many, uses = total["v"], total["n"] or 0
    bits = 1 << 17
    while bits < 12 * many and bits < MAX_FILTER_BITS:
        bits *= 2
    per = bits // FILTER_BLOCKS

    def bitmap(table: pa.Table) -> pa.Table:
        a = table.column("anchor").to_numpy().view(np.uint64)
        bitset = np.zeros(per, bool)
        for s in AnchorFilter.spots(a, per):
            bitset[s] = True
        return pa.table({"block": table.column("block").slice(0, 1),
                         "bits": pa.array([np.packbits(bitset, bitorder="little").tobytes()], pa.binary())})

    blocked = anchors.select(F.shiftrightunsigned("anchor", 54).cast("int").alias("block"), "anchor")
    table = np.zeros((FILTER_BLOCKS, per // 8), np.uint8)
    for r in blocked.groupBy("block").applyInArrow(bitmap, "block int, bits binary").collect():  # bounded in all
        table[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    hot = anchors.filter(F.col("n") >= max(HOT, -(-uses // MAX_HOT))).select("anchor").toPandas()["anchor"]
    return AnchorFilter(bits, table), np.sort(hot.to_numpy(np.int64).view(np.uint64))


# ---- shards --------------------------------------------------------------------------------

def covered_windows(low: list[int], texts: list[list], window: int = WINDOW) -> list[int]:
    """For distinct segments (first document, words): a bit per window that occurs in a
    segment whose first document is smaller."""
    masks = [0] * len(low)
    order = sorted(range(len(low)), key=lambda i: low[i])
    automaton = SuffixAutomaton()
    waiting: list[int] = []
    for i in order:
        if waiting and low[waiting[0]] != low[i]:
            for j in waiting:
                automaton.add(texts[j])
            waiting = []
        waiting.append(i)
        if len(automaton.size) > 1:
            for end, n in enumerate(automaton.matches(texts[i])):
                if n >= window:
                    masks[i] |= 1 << (end - window + 1)
    return masks


def _shard(table: pa.Table) -> pa.Table:
    """One row (key, low, mask) per distinct segment of a shard that some window of some
    document is removed by."""
    anchor, key = table.column("anchor").to_numpy(), table.column("key").to_numpy()
    low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
    texts = table.column("text")
    order = np.lexsort((low, key, anchor))
    out: list[tuple[int, int, int]] = []
    i, n = 0, len(order)
    while i < n:
        j = i
        segments: list[list] = []  # key, low, high, row
        while j < n and anchor[order[j]] == anchor[order[i]]:
            r = order[j]
            if segments and segments[-1][0] == key[r]:
                segments[-1][2] = max(segments[-1][2], int(high[r]))
            else:
                segments.append([int(key[r]), int(low[r]), int(high[r]), int(r)])
            j += 1
        if len(segments) > 1:
            masks = covered_windows([s[1] for s in segments], [texts[s[3]].as_py().split(b" ") for s in segments])
        else:
            masks = [0]
        out += [(k, lo, m) for (k, lo, hi, _), m in zip(segments, masks) if hi > lo or m]
        i = j
    k, lo, m = zip(*out) if out else ((), (), ())
    return pa.table({"key": pa.array(k, pa.int64()), "low": pa.array(lo, pa.int64()), "mask": pa.array(m, pa.int32())})


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(_id, _hash, spans): per row with words to remove, its windows as (start, bits) pairs."""
    spark = rows.sparkSession
    anchors = publish(shared_anchors(rows), "shared-anchors")
    shared = spark.sparkContext.broadcast(anchor_filter(anchors))

    def shared_segments(b: pa.RecordBatch) -> Iterator[tuple[int, Segments]]:
        keep, hot = shared.value
        for at, _, buf, offs in text_chunks(b.column("text")):
            s = Segments(buf, offs)
            s.keep(keep.has(s.anchor))
            s.split(hot)
            if len(s.anchor):
                yield at, s

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("_id").to_numpy()
            for at, s in shared_segments(b):
                key, doc = s.keys(), ids[at + s.doc]
                order = np.lexsort((doc, key))
                new = np.ones(len(order), bool)
                new[1:] = key[order][1:] != key[order][:-1]
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(order)) - 1
                pick = order[first]
                yield pa.RecordBatch.from_arrays([
                    pa.array(s.anchor[pick].view(np.int64)), pa.array(key[pick].view(np.int64)), pa.array(doc[pick]),
                    pa.array(doc[order[last]]), pa.array([s.text(i) for i in pick], pa.binary())],
                    names=["anchor", "key", "low", "high", "text"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th = b.column("_id").to_numpy(), b.column("_hash").to_numpy()
            for at, s in shared_segments(b):
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[at + s.doc]), pa.array(th[at + s.doc]), pa.array(s.word.astype(np.int32)),
                    pa.array(s.count.astype(np.int32)), pa.array(s.keys().view(np.int64))],
                    names=["_id", "_hash", "start", "count", "key"])

    shards = max(8 * shuffle_partitions(spark), 64)
    dealt = (rows.mapInArrow(distinct, "anchor long, key long, low long, high long, text binary")
             .withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int")))
    found = publish(dealt.groupBy("shard").applyInArrow(_shard, "key long, low long, mask int"), "repeated-segments")
    occurrences = rows.mapInArrow(places, "_id long, _hash long, start int, `count` int, key long")
    bits = (F.when(F.col("_id") > F.col("low"), F.expr("shiftleft(1, `count`) - 1"))
            .when(F.col("_id") == F.col("low"), F.col("mask")).otherwise(0))
    return (occurrences.join(found, "key").withColumn("bits", bits).filter("bits != 0")
            # rows that repeat an id and its text have one list, each span once
            .groupBy("_id", "_hash").agg(F.collect_set(F.struct("start", "bits")).alias("spans")))


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"),
                       F.xxhash64("text").alias("_hash"), "text")


def _removals(b: pa.RecordBatch, text: str = "text", window: int = WINDOW) -> Iterator[tuple[np.ndarray, Words, np.ndarray]]:
    """(rows, words, mask of removed words) chunk by chunk of a batch with ``spans``."""
    spans = b.column("spans")
    offsets = spans.offsets.to_numpy() if len(spans) else np.zeros(1, np.int64)
    flat = spans.values
    start, bits = flat.field("start").to_numpy(), flat.field("bits").to_numpy()
    valid = spans.is_valid().to_numpy(zero_copy_only=False)
    for at, to, buf, offs in text_chunks(b.column(text)):
        words = Words(buf, offs)
        edge = np.zeros(len(words) + 1, np.int64)
        for r in range(at, to):
            if not valid[r]:
                continue
            base = words.first[r - at]
            for s, m in zip(start[offsets[r]:offsets[r + 1]].tolist(), bits[offsets[r]:offsets[r + 1]].tolist()):
                while m:
                    low = (m & -m).bit_length() - 1
                    run = ((m >> low) + 1 & -((m >> low) + 1)).bit_length() - 1  # consecutive windows
                    edge[base + s + low] += 1
                    edge[base + s + low + run + window - 1] -= 1
                    m &= ~(((1 << run) - 1) << low)
        yield np.arange(at, to), words, np.cumsum(edge[:-1]) > 0


def _kept_text(words: Words, gone: np.ndarray, doc: int) -> bytes:
    a, z = words.first[doc], words.first[doc + 1]
    return b" ".join([words.buf[words.start[i]:words.end[i]].tobytes() for i in range(a, z) if not gone[i]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space) of
    every whole text.

    A null text has no words.  Rows with one doc_id do not remove from each other, copies or
    not.  A null doc_id counts as larger than all others.  Texts below 13 words lose nothing.
    An empty table gives no rows; extra columns are ignored."""
    rows = _keyed(docs, "doc_id")
    spans = repeated_windows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, digests = [], [], []
            for at, words, gone in _removals(b):
                gone_in = np.concatenate([[0], np.cumsum(gone)])
                n.append(words.counts())
                removed.append(gone_in[words.first[1:]] - gone_in[words.first[:-1]])
                digests += [hashlib.sha256(_kept_text(words, gone, i)).hexdigest() for i in range(len(at))]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(np.concatenate(n) if n else [], pa.int64()),
                pa.array(np.concatenate(removed) if removed else [], pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return (rows.join(spans, ["_id", "_hash"], "left").select("doc_id", "text", "spans")
            .mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the covered words removed from the texts.  A text that loses nothing
    stays as it is; of another the kept words are joined by one space; a text that loses all
    its words goes.  ``n_chars`` (if there) is brought up to date."""
    plain, name = masked(docs)
    text = name["text"]
    rows = (plain.withColumn("_id", F.coalesce(F.col(name["doc_id"]).cast("long"), F.lit(LAST)))
            .withColumn("_hash", F.xxhash64(text)))
    spans = repeated_windows(rows.select("_id", "_hash", F.col(text).alias("text")))
    joined = rows.join(spans, ["_id", "_hash"], "left").select(*plain.columns, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, emptied = b.column(text).to_pylist(), [False] * b.num_rows
            for at, words, gone in _removals(b, text):
                for i in np.unique(words.doc[gone]).tolist():
                    left = _kept_text(words, gone, i)
                    texts[at[i]], emptied[at[i]] = left.decode(), not left
            columns = dict(zip(b.schema.names[:-1], b.columns[:-1])) | {text: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(emptied)], names=[*columns, "_emptied"])

    cut = joined.mapInArrow(run, extended(plain, _emptied="boolean")).filter("not _emptied").drop("_emptied")
    if "n_chars" in name:
        cut = cut.withColumn(name["n_chars"], F.char_length(F.coalesce(text, F.lit("")))
                             .cast(docs.schema["n_chars"].dataType))
    return cut.toDF(*docs.columns)
