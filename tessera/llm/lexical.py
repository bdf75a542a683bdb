"""Ranked lexical search for many items at once, by common-subexpression evaluation.

An item's score for a document is a sum over the item's terms, repeats included, of integers
that depend on the term and the document only.  Items share terms, so the sums share parts:

* ``build_plan`` looks at a block of items (their texts, at most about ``BLOCK_BYTES``) on the
  driver.  A term that an item holds c times is c in powers of two, each the double of the one
  before.  Terms that stand in the same items (two or more) become one shared set; then the pair
  of parts that most items share becomes a new part, again and again, while two items share
  one.  The outcome is a graph of additions: terms at the bottom, shared sets above, items on top.
* One pass over the texts counts, for each document, its terms and the occurrences of the
  block's terms (by their 64-bit hashes), and publishes these postings.  Sums over them give
  the collection's statistics.
* One pass over the postings keeps an accumulator per part and document of a chunk: every
  shared part is added up once per document, whatever the number of items above it.  Each task
  keeps the best documents of every item as it goes and returns only those; they meet by (item,
  salt), then by item.

All sums are 64-bit integers, so sharing changes no score.  No table of documents or pairs goes
through the driver: it sees one block of items and one row for each of its terms."""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_TERM, LOWER, Words, joined, publish, text_chunks

K = 20
BLOCK_BYTES = 1 << 20  # of items' texts that are evaluated together
MINED = 48  # parts of an item (the most shared ones) among which shared pairs are looked for
CELLS = 1 << 22  # accumulators (parts x documents) kept at once
SALTS = 64

_NORMAL = bytes(int(LOWER[c]) if IS_TERM[c] else 32 for c in range(256))


@dataclass
class Plan:
    """Parts 0 .. len(hashes) - 1 are terms (sorted by hash); the others are the sum of two
    parts each, level after level.  Item i is the sum of ``parts[cuts[i]:cuts[i + 1]]``."""
    hashes: np.ndarray
    words: list[str]
    left: np.ndarray
    right: np.ndarray
    levels: list[tuple[int, int]]
    parts: np.ndarray
    cuts: np.ndarray

    @property
    def size(self) -> int:
        return len(self.hashes) + len(self.left)


def terms(text: bytes) -> list[bytes]:
    """The terms of a text: runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_NORMAL).split()


def build_plan(texts: list[str]) -> Plan:
    """The graph of shared sums of the items' texts, each with at least one term."""
    counted = [Counter(terms(t.encode())) for t in texts]
    words = sorted({w for c in counted for w in c})
    hashes = Words(*joined(words), IS_TERM).hashes()
    order = np.argsort(hashes)
    number = {words[j]: i for i, j in enumerate(order.tolist())}
    made: list[tuple[int, int]] = []  # the parts that are sums

    def add(a: int, b: int) -> int:
        made.append((a, b))
        return len(words) + len(made) - 1

    doubles: dict[tuple[int, int], int] = {}
    items: list[set[int]] = []
    for c in counted:
        mine = set()
        for w, n in c.items():
            part, bit = number[w], 0
            while n >> bit:
                if n >> bit & 1:
                    mine.add(part)
                bit += 1
                if n >> bit:
                    key = (number[w], bit)
                    if key not in doubles:
                        doubles[key] = add(part, part)
                    part = doubles[key]
        items.append(mine)

    # parts that stand in the same items, two or more: one shared set
    holders: dict[int, list[int]] = defaultdict(list)
    for i, mine in enumerate(items):
        for p in mine:
            holders[p].append(i)
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for p in sorted(holders):
        if len(holders[p]) > 1:
            alike[tuple(holders[p])].append(p)
    for its, group in alike.items():
        while len(group) > 1:  # in pairs, so the sums stay flat
            sums = [add(a, b) for a, b in zip(group[::2], group[1::2])]
            for i in its:
                items[i].difference_update(group[:2 * len(sums)])
                items[i].update(sums)
            group = sums + group[2 * len(sums):]

    _mine_pairs(items, add)
    return _ordered(words, hashes[order], order, made, items)


def _mine_pairs(items: list[set[int]], add) -> None:
    """Replace the pair of parts that most items share by their sum, while two items share one."""
    holders: dict[int, set[int]] = defaultdict(set)
    for i, mine in enumerate(items):
        for p in mine:
            holders[p].add(i)
    looked_at = []
    counts: Counter = Counter()
    for mine in items:
        top = sorted((p for p in mine if len(holders[p]) > 1), key=lambda p: (-len(holders[p]), p))[:MINED]
        looked_at.append(set(top))
        counts.update(combinations(sorted(top), 2))
    heap = [(-n, pair) for pair, n in counts.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, (a, b) = heapq.heappop(heap)
        now = counts[a, b]
        if now < 2:
            continue
        if now != -n:
            heapq.heappush(heap, (-now, (a, b)))
            continue
        c = add(a, b)
        for i in sorted(i for i in holders[a] & holders[b] if a in looked_at[i] and b in looked_at[i]):
            mine = looked_at[i]
            mine -= {a, b}
            items[i] -= {a, b}
            holders[a].discard(i)
            holders[b].discard(i)
            counts[a, b] -= 1
            for x in mine:
                counts[min(a, x), max(a, x)] -= 1
                counts[min(b, x), max(b, x)] -= 1
                counts[x, c] += 1
                if counts[x, c] > 1:
                    heapq.heappush(heap, (-counts[x, c], (x, c)))
            mine.add(c)
            items[i].add(c)
            holders[c].add(i)


def _ordered(words, hashes, order, made, items) -> Plan:
    """Number the sums by level: a level's sums only need those of the levels before."""
    base = len(words)
    depth = [0] * base
    for a, b in made:
        depth.append(max(depth[a], depth[b]) + 1)
    ranked = sorted(range(base, len(depth)), key=lambda p: (depth[p], p))
    new = list(range(base)) + [0] * len(made)
    for i, p in enumerate(ranked):
        new[p] = base + i
    left = np.array([new[made[p - base][0]] for p in ranked], np.int64)
    right = np.array([new[made[p - base][1]] for p in ranked], np.int64)
    heights = np.array([depth[p] for p in ranked], np.int64)
    edges = np.searchsorted(heights, np.arange(1, (heights[-1] if len(heights) else 0) + 2))
    levels = [(base + int(a), base + int(b)) for a, b in zip(edges[:-1], edges[1:])]
    flat = [sorted(new[p] for p in mine) for mine in items]
    cuts = np.concatenate([[0], np.cumsum([len(f) for f in flat])]).astype(np.int64)
    return Plan(hashes, [words[j].decode() for j in order.tolist()], left, right, levels,
                np.array([p for f in flat for p in f], np.int64), cuts)


def accumulate(plan: Plan, values: np.ndarray) -> np.ndarray:
    """Scores (items x documents) from the terms' values (terms x documents)."""
    acc = np.empty((plan.size, values.shape[1]), np.int64)
    base = len(plan.hashes)
    acc[:base] = values
    for a, b in plan.levels:
        np.add(acc[plan.left[a - base:b - base]], acc[plan.right[a - base:b - base]], out=acc[a:b])
    return np.add.reduceat(acc[plan.parts], plan.cuts[:-1], axis=0)


# ---- postings and statistics -----------------------------------------------------------------

POSTINGS = "doc_id long, n long, terms binary, tfs binary"


def postings(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its number of terms, and the
    plan's terms it holds with their occurrences (32-bit and 64-bit integers, packed)."""
    hashes = plan.hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                words = Words(LOWER[buf], offs, IS_TERM)
                n = words.counts()
                h = words.hashes()
                slot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                at = np.flatnonzero(hashes[slot] == h)
                pair, tf = np.unique(words.doc[at] * len(hashes) + slot[at], return_counts=True)
                cut = np.searchsorted(pair, np.arange(hi - lo + 1) * len(hashes))
                term = (pair % len(hashes)).astype(np.int32)
                some = np.flatnonzero(n)

                def packed(a: np.ndarray) -> pa.Array:
                    return pa.array([a[cut[i]:cut[i + 1]].tobytes() for i in some.tolist()], pa.binary())

                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(pa.array(some)), pa.array(n[some], pa.int64()), packed(term),
                     packed(tf.astype(np.int64))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, POSTINGS)


def statistics(posted: DataFrame, plan: Plan) -> tuple[int, int, np.ndarray]:
    """N (documents), L (their terms) and the number of documents that hold each term of the
    plan: one row for each term and task is shuffled, one for each term comes to the driver."""
    size = len(plan.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, total = np.zeros(size, np.int64), 0, 0
        for b in batches:
            for packed in b.column("terms").to_pylist():
                held[np.frombuffer(packed, np.int32)] += 1
            docs += b.num_rows
            total += int(np.sum(b.column("n").to_numpy()))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [size, size + 1]]), pa.int64()),
                                          pa.array(np.concatenate([held[some], [docs, total]]), pa.int64())], names=["term", "c"])

    rows = posted.select("n", "terms").mapInArrow(run, "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(size + 2, np.int64)
    for r in rows:
        counts[r.term] = r.c
    return int(counts[size]), int(counts[size + 1]), counts[:size]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The k best rows (score, then id, a missing id last) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows = [np.empty(0, np.int64)] * 4  # item, score, id, whether the id is missing
        self.least = np.ones(items, np.int64)  # a score below can't enter any more

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        new = (item, scores[item, doc], ids[doc], missing[doc])
        rows = [np.concatenate(x) for x in zip(self.rows, new)]
        order = np.lexsort([rows[2], rows[3], -rows[1], rows[0]])
        item = rows[0][order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[rank < self.k]
        self.rows = [r[keep] for r in rows]
        full = np.flatnonzero(np.bincount(self.rows[0], minlength=len(self.least)) == self.k)
        last = np.searchsorted(self.rows[0], full, side="right") - 1
        self.least[full] = self.rows[1][last]


def _best_in_tasks(posted: DataFrame, keys: list[str], plan: Plan, n_docs: int, total: int, weights: np.ndarray,
                   k: int) -> DataFrame:
    """(key, doc_id, score): each task's best rows of every item of the block."""
    size = len(plan.hashes)
    step = max(1, CELLS // (plan.size + len(plan.parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(plan.cuts) - 1, k)
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                m = 75 + (25 * b.column("n").to_numpy() * n_docs) // total
                lists = b.column("terms").to_pylist()
                term = np.frombuffer(b"".join(lists), np.int32)
                tf = np.frombuffer(b"".join(b.column("tfs").to_pylist()), np.int64)
                doc = np.repeat(np.arange(b.num_rows), [len(x) // 4 for x in lists])
                values = np.zeros((size, b.num_rows), np.int64)
                values[term, doc] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                ids = b.column("doc_id")
                best.add(accumulate(plan, values), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64))
        item, score, doc, missing = best.rows
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in item.tolist()], pa.string()),
                                          pa.array(doc, pa.int64(), mask=missing.astype(bool)), pa.array(score, pa.int64())],
                                         names=["key", "doc_id", "score"])

    return posted.mapInArrow(run, "key string, doc_id long, score long")


def _ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(keys: list[str], plan: Plan, docs: DataFrame, k: int) -> DataFrame:
    """(key, rank, doc_id, score) of a block's items."""
    spark = docs.sparkSession
    posted = publish(postings(docs, plan), "postings")
    n_docs, total, held = statistics(posted, plan)
    if not total:
        return spark.createDataFrame([], "key string, rank int, doc_id long, score long")
    weights = np.array([weight(n_docs, int(d)) for d in held], np.int64)
    rows = _best_in_tasks(posted, keys, plan, n_docs, total, weights, k)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    return _ranked(_ranked(salted, ["key", "salt"], k).drop("rank"), ["key"], k).select("key", "rank", "doc_id", "score")


def search(items: DataFrame, docs: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of every item (columns
    item_id, text) with a score above 0, ties to the smaller doc_id (a null one last).

    A null text has no terms: such an item has no rows, such a document does not count.  Rows
    with one doc_id are documents of their own; items of equal text are evaluated once, and
    every row of ``items`` gets its rows.  Without items or documents there are no rows.  Other
    columns are ignored.  Items are worked on in blocks of about ``BLOCK_BYTES``, each by one
    pass over all texts."""
    spark = docs.sparkSession
    key = F.sha2("text", 256)
    asked = items.filter(F.col("text").isNotNull()).select("item_id", key.alias("key"), "text")
    distinct = asked.groupBy("key").agg(F.first("text").alias("text"))
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks))
    found = None
    for i in range(blocks):
        rows = [r for r in distinct.filter(block == i).collect() if terms(r.text.encode())]  # bounded: one block
        if rows:
            rows.sort(key=lambda r: r.key)
            part = _search_block([r.key for r in rows], build_plan([r.text for r in rows]), docs, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return asked.drop("text").join(found, "key").select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
sizes AS (SELECT r, doc_id, len(ws) AS n FROM d WHERE len(ws) > 0),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
occurrences AS (SELECT r, unnest(ws) AS term FROM d),
tfs AS (SELECT r, term, count(*) AS tf FROM occurrences GROUP BY r, term),
i AS (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS term FROM benchmark),
counts AS (SELECT q, item_id, term, count(*) AS c FROM i GROUP BY q, item_id, term),
dfs AS (SELECT term, count(*) AS df FROM tfs WHERE term IN (SELECT term FROM i) GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM dfs, total),
parts AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))) AS v
  FROM tfs JOIN w USING (term) JOIN sizes USING (r), total),
scores AS (SELECT q, item_id, r, doc_id, CAST(sum(c * v) AS BIGINT) AS score
  FROM parts JOIN counts USING (term) GROUP BY q, item_id, r, doc_id HAVING sum(c * v) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rk FROM scores)
SELECT item_id, CAST(rk AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rk <= {K}
"""
