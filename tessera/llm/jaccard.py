"""Exact n-gram Jaccard join: groups of documents linked by the similarity of their shingle
sets, by tries.

1. Equal sets are folded into one (a group of copies costs one row per task).
2. Candidate clusters.  All shingles are counted (by hash, into levels of bounded size), which
   gives them one order, rarest first.  Sets x, y with Jaccard similarity of at least p% share
   ``ceil(p / 100 * max(|x|, |y|))`` shingles or more, so the rarest one that they share is among
   the first ``|x| - ceil(p / 100 * |x|) + 1`` of x, and likewise of y.  These are the signatures
   of a set, without those that no other text has.  Sets that share a signature are linked to
   the smallest such set, first within a task's batch, then on the cluster; the connected
   components hold every similar pair.  Passages that many sets share don't link them, unless
   a set hardly holds anything rarer.
3. Each cluster's sets, in one order of their shingles (rarest first), go into a prefix tree:
   sets with a common beginning share a path, so their overlap with a query is counted once;
   a subtree is left when the shingles that remain on either side can't reach the overlap its
   smallest set needs, when no size in it fits, or when none of its sets shares one of the
   first shingles that a similar set must share.  Pairs within one group are not visited.
4. A cluster of more than ``block`` sets is cut into blocks by hash.  Each block is joined on
   its own; then the blocks' groups are compared by one set each; then, unless one group is
   left, every set outside the largest group meets every block, in tasks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, bounded, masked, mix, publish, shingle_sets, shuffle_partitions, text_chunks
from .components import components

SHINGLE = 4
PERCENT = 85
BLOCK = 4000  # sets of a block, on average
SIGNATURES = 1 << 19  # signatures that a task folds at once
LEVELS = (2, 4, 16, 128)  # numbers of texts that part the levels of how common a shingle is


# ---- sets and signatures -------------------------------------------------------------------

def sets_of(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    words = Words(LOWER[buf], offs)
    return shingle_sets(words, words.hashes(), k)


def identity(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that stand for a set."""
    a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    pair = mix(np.array([a, b ^ np.uint64(len(s))], np.uint64)).view(np.int64)
    return int(pair[0]), int(pair[1])


def first_shingles(size: int, percent: int) -> int:
    """How many shingles of a set, in any one order of all shingles, hold the first one that it
    shares with a similar set."""
    return size - (-(-percent * size // 100)) + 1


def signatures(s: np.ndarray, percent: int = PERCENT, levels: np.ndarray | None = None) -> np.ndarray:
    """The set's first shingles by (level, hash).  ``levels`` (see ``Levels``) is a number per
    shingle, and a shingle of level 0 is in no other set, so it doesn't sign; without ``levels``
    the hashes alone are the order.  Two similar sets have a signature in common."""
    n = first_shingles(len(s), percent)
    if levels is None:
        return s[:n]
    at = np.argsort(levels, kind="stable")[:n]  # the set is sorted by hash
    return s[at[levels[at] > 0]]


class Levels:
    """How common shingles are: for each bound of ``LEVELS`` a bitmap, by hash, of the shingles
    in at least so many texts (a bit may stand for several shingles, so a shingle may seem more
    common than it is, the same for every set).  The bitmaps grow with the corpus, up to a fixed size."""

    SHARDS, LEAST, MOST = 256, 1 << 13, 1 << 19  # shards, and bits of a shard's bitmap

    @classmethod
    def bits_for(cls, shingles: int) -> int:
        bits = cls.LEAST
        while bits * cls.SHARDS < shingles and bits < cls.MOST:
            bits *= 2
        return bits

    def __init__(self, bitmaps: np.ndarray):
        self.bitmaps = bitmaps.reshape(len(LEVELS), -1)  # uint8 [levels, SHARDS * bits / 8]
        self.bits = self.bitmaps.shape[1] * 8 // self.SHARDS

    def of(self, s: np.ndarray) -> np.ndarray:
        spot = (s >> np.uint64(56)) * np.uint64(self.bits) + (s >> np.uint64(32)) % np.uint64(self.bits)
        byte, bit = (spot >> np.uint64(3)).astype(np.int64), (spot & np.uint64(7)).astype(np.uint8)
        out = np.zeros(len(s), np.int8)
        left = np.arange(len(s))
        for i in range(len(LEVELS)):  # the shingles of a level are among those of the one before
            left = left[(self.bitmaps[i][byte[left]] >> bit[left]) & 1 > 0]
            out[left] = i + 1
        return out


# ---- the prefix tree -----------------------------------------------------------------------

class Node:
    __slots__ = ("run", "below", "ends", "least", "most", "left", "up", "stamp")

    def __init__(self, run, up):
        self.run = run  # shingles on the edge into this node
        self.up: Node | None = up
        self.below: dict[int, Node] = {}
        self.ends: list[int] = []
        self.least, self.most = 1 << 60, 0  # sizes of the sets below
        self.left = 0  # most shingles that follow on any path below
        self.stamp = 0


class PrefixTree:
    """Sets as paths of shingle ranks (rarest first); edges hold runs of them."""

    def __init__(self, percent: int):
        self.percent = percent
        self.root = Node(np.empty(0, np.int64), None)
        self.place: dict[int, Node] = {}  # where each set ends
        self.turn = 0

    def add(self, s: np.ndarray, number: int) -> None:
        node, at, n = self.root, 0, len(s)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            node.left = max(node.left, n - at)
            if at == n:
                break
            child = node.below.get(int(s[at]))
            if child is None:
                leaf = Node(s[at:], node)
                leaf.least = leaf.most = n
                node.below[int(s[at])] = leaf
                node = leaf
                break
            m = min(len(child.run), n - at)
            differ = np.flatnonzero(child.run[:m] != s[at:at + m])
            shared = int(differ[0]) if len(differ) else m
            if shared < len(child.run):  # cut the edge
                upper = Node(child.run[:shared], node)
                upper.least, upper.most, upper.stamp = child.least, child.most, child.stamp
                upper.left = child.left + len(child.run) - shared
                child.run, child.up = child.run[shared:], upper
                upper.below[int(child.run[0])] = child
                node.below[int(s[at])] = upper
                child = upper
            node, at = child, at + shared
        node.ends.append(number)
        self.place[number] = node

    def similar(self, s: np.ndarray, wanted: list[int]) -> int | None:
        """One of the ``wanted`` sets that is at least as similar as asked, if any.  Only
        paths to wanted sets are walked, and their common beginnings once."""
        n, p = len(s), self.percent
        self.turn += 1
        for j in wanted:
            node = self.place[j]
            while node is not None and node.stamp != self.turn:
                node.stamp = self.turn
                node = node.up
        stack = [(c, 0, 0) for c in self.root.below.values() if c.stamp == self.turn]
        wanted = set(wanted)
        while stack:
            node, overlap, at = stack.pop()
            if node.most * 100 < p * n or node.least * p > 100 * n:
                continue
            run = node.run
            need = -(-p * (n + node.least) // (100 + p))
            if overlap + min(n - at, len(run) + node.left) < need:
                continue
            spot = np.searchsorted(s, run)
            inside = spot < n
            overlap += int((s[spot[inside]] == run[inside]).sum())
            at = int(np.searchsorted(s, run[-1], "right"))
            if overlap + min(n - at, node.left) < need:
                continue
            if node.ends and (100 + p) * overlap >= p * (n + node.least):  # the sets that end here are its least
                for j in node.ends:
                    if j in wanted:
                        return j
            for c in node.below.values():
                if c.stamp == self.turn:
                    stack.append((c, overlap, at))
        return None


class Groups:
    """Union-find over numbers."""

    def __init__(self, labels):
        self.up = list(range(len(labels)))
        self.count = len(labels)
        seen: dict = {}
        for i, x in enumerate(labels):
            if x in seen:
                self.join(i, seen[x])
            else:
                seen[x] = i

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.count -= 1


def ranked(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets as sorted ranks in one order of all their shingles: rarest first, then by hash."""
    if not sets:
        return []
    values, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, count))] = np.arange(len(values))
    return [np.sort(x) for x in np.split(rank[back], np.cumsum([len(s) for s in sets])[:-1])]


class Holders:
    """Which sets (as ranks) have a shingle: lists of set numbers, of the sets that can be found."""

    def __init__(self, sets: list[np.ndarray], asks: list[bool] | None):
        size = np.array([len(s) for s in sets], np.int64)
        self.first = np.concatenate([[0], np.cumsum(size)])
        ranks, number = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), size)
        order = np.argsort(ranks, kind="stable")  # in a list by number
        self.asks = asks is not None
        if self.asks:
            order = order[~np.array(asks, bool)[number[order]]]
        self.number = number[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(ranks[order], minlength=int(ranks.max()) + 1))])
        self.place = np.empty(0 if self.asks else len(ranks), np.int64)
        if not self.asks:
            self.place[order] = np.arange(len(order))

    def shared(self, i: int, s: np.ndarray, needed: int) -> np.ndarray | None:
        """How many shingles set i shares with each of the others (without asking sets: of those before
        it); None if it shares none of its first ``needed``."""
        low = self.begin[s]
        high = self.begin[s + 1] if self.asks else self.place[self.first[i]:self.first[i + 1]]
        some = high > low
        if not some[:needed].any():
            return None
        lists = [self.number[x:y] for x, y in zip(low[some].tolist(), high[some].tolist())]
        return np.bincount(np.concatenate(lists))


def link_all(sets: list[np.ndarray], labels: list, percent: int, asks: list[bool] | None = None) -> Groups:
    """Groups of similar sets; sets with one label are one group to begin with.  With
    ``asks``, only pairs of an asking and another set are looked for.

    Sets come by size.  Two similar sets share one of their first shingles (see
    ``first_shingles``) in the common order; if a set shares one, what it shares with each of those
    before it (with ``asks``: with all that don't ask) is counted along the lists of its
    shingles, and of every other group with enough in common one set is looked for in the tree."""
    groups = Groups(labels)
    if not sets:
        return groups
    sets = ranked(sets)
    size = np.array([len(s) for s in sets], np.int64)
    tree, holders = PrefixTree(percent), Holders(sets, asks)
    if asks is not None:
        for i in range(len(sets)):
            if not asks[i]:
                tree.add(sets[i], i)
    for i, s in enumerate(sets):
        if asks is not None and not asks[i]:
            continue
        if groups.count == 1:
            break
        overlap = holders.shared(i, s, first_shingles(len(s), percent))
        if overlap is not None:
            enough = (overlap > 0) & ((100 + percent) * overlap >= percent * (len(s) + size[:len(overlap)]))
            for j in np.flatnonzero(enough).tolist():
                if groups.find(j) != groups.find(i) and tree.similar(s, [j]) is not None:
                    groups.join(i, j)
        if asks is None:
            tree.add(s, i)
    return groups


# ---- on Spark ------------------------------------------------------------------------------

def shingle_identities(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n (size of the shingle set) and its identity (sa, sb)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(s), *identity(s)) for _, _, buf, offs in text_chunks(b.column("text")) for s in sets_of(buf, offs, k)]
            n, sa, sb = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, sa, sb))],
                                             names=["doc_id", "n", "sa", "sb"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sa long, sb long")


def common_shingles(texts: DataFrame, k: int = SHINGLE, shingles: int = 0) -> Levels:
    """The levels of the shingles of ``texts``, which have about ``shingles`` together.  Shingles
    travel packed, as 32 bits within one of 256 shards."""
    bits = Levels.bits_for(shingles)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, offs in text_chunks(b.column("text")):
                every = np.sort(np.concatenate(sets_of(buf, offs, k)))
                cut = np.searchsorted(every >> np.uint64(56), np.arange(Levels.SHARDS + 1))
                low = ((every >> np.uint64(24)) & np.uint64(0xFFFFFFFF)).astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(Levels.SHARDS, dtype=np.int32)),
                    pa.array([low[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], names=["shard", "low"])

    def count(table: pa.Table) -> pa.Table:
        low = np.sort(np.frombuffer(b"".join(table.column("low").to_pylist()), "<u4"))
        rows = []
        for bound in LEVELS:  # a number stands at two places ``bound - 1`` apart
            flags = np.zeros(bits, bool)
            flags[(low[bound - 1:][low[bound - 1:] == low[:max(0, len(low) - bound + 1)]] >> 8) % bits] = True
            rows.append(np.packbits(flags, bitorder="little").tobytes())
        shard = table.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard] * len(LEVELS), pa.int32()),
                         "level": pa.array(range(len(LEVELS)), pa.int32()), "bits": pa.array(rows, pa.binary())})

    table = np.zeros((len(LEVELS), Levels.SHARDS, bits // 8), np.uint8)
    found = (texts.select("text").mapInArrow(packed, "shard int, low binary").groupBy("shard")
             .applyInArrow(count, "shard int, level int, bits binary"))
    for r in found.toLocalIterator():  # bounded in all: LEVELS x SHARDS x MOST bits
        table[r["level"], r["shard"]] = np.frombuffer(r["bits"], np.uint8)
    return Levels(table)


def candidate_links(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, levels: Levels | None = None) -> DataFrame:
    """(a, b): pairs of set numbers (sa) that share a signature with the smaller of the two
    being the smallest of its batch or of all."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    # shards of signatures: one shuffle, packed (16 bytes a signature), and a sort in numpy; a
    # signature comes once per batch, whose other sets are linked there
    shards = max(64, 8 * shuffle_partitions(docs.sparkSession))

    def stars(sign: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signatures, their smallest sets, links of the other sets to these)."""
        order = np.lexsort((owner, sign))
        sign, owner = sign[order], owner[order]
        new = np.ones(len(sign), bool)
        new[1:] = sign[1:] != sign[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(sign)), 0))
        pairs = np.stack([owner, owner[first]])[:, ~new]
        return sign[new], owner[new], np.unique(pairs[:, pairs[0] != pairs[1]], axis=1)

    def folded(signs: list, owners: list) -> pa.RecordBatch:
        sign, owner, pairs = stars(np.concatenate(signs), np.concatenate(owners))
        shard = (sign % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(shards + 1))
        sign, owner = sign[order].astype("<u8"), owner[order].astype("<i8")
        rows = [(i, False, sign[x:y].tobytes(), owner[x:y].tobytes()) for i, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
        if pairs.size:
            rows.append((int(pairs[0, 0] % shards), True, pairs[0].astype("<i8").tobytes(), pairs[1].astype("<i8").tobytes()))
        at, linked, x, y = zip(*rows) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(linked, pa.bool_()), pa.array(x, pa.binary()),
                                           pa.array(y, pa.binary())], names=["shard", "linked", "x", "y"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        signs, owners, size = [], [], 0
        for b in batches:
            seen: set[int] = set()
            for _, _, buf, offs in text_chunks(b.column("text")):
                for s in sets_of(buf, offs, k):
                    sign = signatures(s, percent, None if levels is None else levels.of(s)) if len(s) else s
                    if len(sign) and (number := identity(s)[0]) not in seen:
                        seen.add(number)
                        signs.append(sign)
                        owners.append(np.full(len(sign), number))
                        size += len(sign)
                if size > SIGNATURES:
                    yield folded(signs, owners)
                    signs, owners, size = [], [], 0
        if signs:
            yield folded(signs, owners)

    def star(table: pa.Table) -> pa.Table:
        linked = table.column("linked").combine_chunks()

        def numbers(rows: pa.Table, column: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(rows.column(column).to_pylist()), kind)

        near, far = table.filter(linked), table.filter(pc.invert(linked))
        _, _, pairs = stars(numbers(far, "x", "<u8"), numbers(far, "y", "<i8"))
        pairs = np.unique(np.concatenate([pairs, np.stack([numbers(near, "x", "<i8"), numbers(near, "y", "<i8")])], axis=1), axis=1)
        return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})

    return (docs.select("text").mapInArrow(signed, "shard int, linked boolean, x binary, y binary")
            .groupBy("shard").applyInArrow(star, "a long, b long").distinct())


def _cut(members: DataFrame, block: int) -> DataFrame:
    """``members`` (cluster, number, ..) plus blocks (of its cluster) and block."""
    # only clusters of more than a block are looked up, so the rows (and texts) stay in place
    wide = (members.groupBy("cluster").agg(F.count("*").alias("size")).filter(F.col("size") > block)
            .select("cluster", F.ceil(F.col("size") / block).alias("_blocks")))
    return (members.join(bounded(wide), "cluster", "left")
            .withColumn("blocks", F.coalesce("_blocks", F.lit(1).cast("bigint"))).drop("_blocks")
            .withColumn("block", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int")))


MEMBER = "cluster long, blocks long, block int, number long, rep long, label long"


def _sets_in(table: pa.Table, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(sets, row of each) of the rows whose text still has the set they stand for; a set that
    comes twice is taken once."""
    sets, rows, seen = [], [], set()
    numbers = table.column("number").to_pylist()
    for at, _, buf, offs in text_chunks(table.column("text")):
        for i, s in enumerate(sets_of(buf, offs, k)):
            number = numbers[at + i]
            if number not in seen and identity(s)[0] == number:
                seen.add(number)
                sets.append(s)
                rows.append(at + i)
    return sets, np.array(rows, np.int64)


def linked_sets(docs: DataFrame, reps: DataFrame, guests: DataFrame, k: int = SHINGLE, percent: int = PERCENT,
                block: int = BLOCK, shingles: int = 0) -> DataFrame:
    """(rep, component): the representatives (``reps``: rep, number = sa) that are similar to
    another one, and the smallest representative they are connected to.  A representative's
    text is that of its doc_id in ``docs`` or ``guests`` (doc_id, text).  ``shingles``: about how
    many all texts have."""
    clusters = components(candidate_links(docs, k, percent, common_shingles(docs, k, shingles)), "a", "b").toDF("number", "cluster")
    # texts are looked up in place unless very many are in clusters; those of clustered representatives are kept
    clusters = publish(clusters.join(reps, "number").select("cluster", "number", "rep"), "clusters")
    texts = docs.filter("doc_id is not null").select("doc_id", "text").unionByName(guests)
    members = publish(texts.join(bounded(clusters), F.col("rep") == F.col("doc_id"))
                      .select("cluster", "number", "rep", "text"), "cluster-members")
    rows = _cut(members, block)

    def join_block(table: pa.Table) -> pa.Table:
        sets, at = _sets_in(table, k)
        order = np.argsort([len(s) for s in sets], kind="stable") if sets else np.empty(0, np.int64)
        sets, at = [sets[i] for i in order], at[order]
        reps = table.column("rep").to_numpy()[at]
        groups = link_all(sets, list(range(len(sets))), percent)
        least: dict[int, int] = {}
        for i, r in enumerate(reps.tolist()):
            g = groups.find(i)
            least[g] = min(r, least.get(g, r))
        out = table.select(["cluster", "blocks", "block", "number", "rep"]).take(pa.array(at))
        return out.append_column("label", pa.array([least[groups.find(i)] for i in range(len(sets))], pa.int64()))

    local = publish(rows.groupBy("cluster", "block").applyInArrow(join_block, MEMBER), "block-groups")
    labels = local.select("rep", "label")
    large = local.filter("blocks > 1")
    if large.limit(1).count() == 0:
        return labels

    def pair_links(sets, names, asks=None) -> pa.Table:
        """(a, b) links between group names found among the sets."""
        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        sets, names = [sets[i] for i in order], [names[i] for i in order]
        asks = [asks[i] for i in order] if asks is not None else None
        groups = link_all(sets, names, percent, asks)
        least: dict[int, int] = {}
        for i, x in enumerate(names):
            g = groups.find(i)
            least[g] = min(x, least.get(g, x))
        pairs = {(x, least[groups.find(i)]) for i, x in enumerate(names) if x != least[groups.find(i)]}
        a, b = zip(*sorted(pairs)) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    texts = rows.filter("blocks > 1").select(F.col("rep").alias("doc_id"), "text")

    def with_text(some: DataFrame) -> DataFrame:
        return some.join(texts, F.col("rep") == F.col("doc_id")).drop("doc_id")

    # one set of every local group, at most about ``block`` groups together
    heads = large.filter("rep = label").select("cluster", "number", "rep", "label")
    heads = _cut(heads, block)

    def join_heads(table: pa.Table) -> pa.Table:
        sets, at = _sets_in(table, k)
        return pair_links(sets, table.column("label").to_numpy()[at].tolist())

    found = publish(with_text(heads).groupBy("cluster", "block").applyInArrow(join_heads, "a long, b long"), "head-links")
    merged = components(found, "a", "b")
    large = publish(large.join(merged, F.col("label") == F.col("node"), "left")
                    .withColumn("label", F.coalesce("component", "label")).drop("node", "component"), "merged-groups")
    sizes = large.groupBy("cluster", "label").agg(F.count("*").alias("size"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("size", F.col("label"))).alias("top"),
                                        F.count("*").alias("groups")).filter("groups > 1")
    still = large.join(main.select("cluster", F.col("top.label").alias("main")), "cluster")
    minor = still.filter("label != main")
    chunks = minor.groupBy("cluster").agg(F.ceil(F.count("*") / block).alias("chunks"))
    each_block = lambda to: F.explode(F.sequence(F.lit(0), F.col(to) - 1))
    asking = (minor.join(chunks, "cluster").withColumn("chunk", F.pmod(F.xxhash64("number", F.lit(1)), F.col("chunks")))
              .withColumn("to", each_block("blocks")).select("cluster", "to", "chunk", "number", "rep", "label", F.lit(True).alias("asks")))
    data = (still.join(chunks, "cluster").withColumn("chunk", each_block("chunks"))
            .select("cluster", F.col("block").cast("long").alias("to"), "chunk", "number", "rep", "label", F.lit(False).alias("asks")))

    def join_cross(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks").to_pylist(), bool)
        part = [table.filter(pa.array(asks == flag)) for flag in (False, True)]
        sets, names, flags = [], [], []
        for flag, t in zip((False, True), part):
            s, at = _sets_in(t, k)
            sets += s
            names += t.column("label").to_numpy()[at].tolist()
            flags += [flag] * len(s)
        return pair_links(sets, names, flags)

    cross = with_text(asking.unionByName(data)).groupBy("cluster", "to", "chunk").applyInArrow(join_cross, "a long, b long")
    final = components(found.unionByName(publish(cross, "cross-links")), "a", "b")
    return (labels.join(final, F.col("label") == F.col("node"), "left")
            .select("rep", F.coalesce("component", "label").alias("label")))


def similar_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles (size of the shingle set) and component_id (the smallest doc_id
    reachable by links, its own included).

    A text with fewer than ``k`` words has its whole sequence as its one shingle; a null text
    or one without words has none and is linked with nothing.  Repeated rows are linked like
    copies.  Rows with a null id link like all others; their component is null only if no id
    is reachable.  An empty table gives no rows; extra columns are ignored."""
    rows = publish(shingle_identities(docs, k), "shingle-sets")
    # a set that no row with an id has is represented by one of its texts, under a hash of it
    guests = publish(docs.filter("doc_id is null and text is not null").select(F.xxhash64("text").alias("doc_id"), "text")
                     .dropDuplicates(["doc_id"]), "texts-without-id")
    unnamed = shingle_identities(guests, k).filter("n > 0").select("sa", "sb", F.lit(None).cast("long").alias("doc_id"), F.col("doc_id").alias("guest"))
    sets = (rows.filter("n > 0 and doc_id is not null").select("sa", "sb", "doc_id", F.lit(None).cast("long").alias("guest"))
            .unionByName(unnamed).groupBy("sa", "sb").agg(F.min("doc_id").alias("least"), F.min("guest").alias("guest")))
    sets = publish(sets.select("sa", "sb", "least", F.coalesce("least", "guest").alias("rep")), "distinct-sets")
    shingles = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    labels = linked_sets(docs.select("doc_id", "text"), sets.select("rep", F.col("sa").alias("number")), guests,
                         k, percent, block, shingles).groupBy("rep").agg(F.min("label").alias("label"))
    groups = publish(sets.join(labels, "rep", "left").select("sa", "sb", "least", F.coalesce("label", "rep").alias("label")), "set-groups")
    # the label is the smallest id, except where a set without one takes part
    odd = groups.groupBy("label").agg(F.min("least").alias("id"), F.count("least").alias("named"), F.count("*").alias("all"))
    odd = odd.filter("named < all").select("label", "id", F.lit(True).alias("odd"))
    groups = groups.join(odd, "label", "left").select("sa", "sb", F.when(F.col("odd"), F.col("id")).otherwise(F.col("label")).alias("component_id"))
    some = rows.filter("n > 0").join(groups, ["sa", "sb"]).select("doc_id", "n", "component_id")
    none = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group (rows without words and
    with a null id all stay; repeated rows of one id stay together)."""
    keep = similar_groups(docs, k, percent).filter("component_id = doc_id").select(F.col("doc_id").alias("_keep")).distinct()
    plain, name = masked(docs)
    doc_id = F.col(name["doc_id"])
    return (plain.filter(doc_id.isNotNull()).join(keep, doc_id == F.col("_keep")).drop("_keep")
            .unionByName(plain.filter(doc_id.isNull()))).toDF(*docs.columns)
