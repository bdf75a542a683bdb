"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features (all rates, so that length does not decide): densities of a weighted lexicon and of
its strongest words, lexicon words near a second-person word, capitals, punctuation, and
signs of obfuscation (letters replaced by digits or symbols, letters spaced out, lexicon
words that appear only after undoing that).  The lexicon itself is learned: the words whose
share among toxic labelled texts exceeds that among the others the most, near copies counted
once.  Trees and calibration are trained in numpy on the driver from at most ``SAMPLE``
labelled rows of each class; rows of the kept fold are never looked at."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, extended, text_chunks, window_hashes
from .sampling import bounded_sample, fold, held_out

FOLDS = 4
SAMPLE = 4000  # labelled rows of each class, at most
LEXICON = 128  # lexicon words, at most
THRESHOLD = 0.3
NEAR = 6  # words between a lexicon word and a second-person word that still count as near
TREES, DEPTH, RATE, BINS, MIN_WEIGHT = 80, 3, 0.15, 48, 8.0

# second-person words of the languages at hand
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
                 "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "vosotros")
# characters that stand for a letter in obfuscated words
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})

FEATURES = ("lexicon", "lexicon_strong", "lexicon_kinds", "near_second_person", "second_person", "hidden_lexicon",
            "mixed_words", "spaced_letters", "capitals", "capital_words", "exclamations", "questions", "punctuation",
            "word_length", "log_words")

_EDGE = np.zeros(256, dtype=bool)  # ASCII punctuation, cut from both ends of a word
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _EDGE[_a:_b] = True
_DIGIT_OR_SIGN = re.compile(rb"[0-9@$!|*]")


def bare(word: bytes) -> bytes:
    """A word without ASCII punctuation at its ends, A-Z lower-cased."""
    return word.lower().strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def unhidden(word: bytes) -> bytes:
    """An obfuscated word with stand-ins undone and other signs dropped."""
    return re.sub(r"[^\w]|[\d_]", "", word.decode("utf-8", "ignore").lower().translate(STAND_INS)).encode()


class Features:
    """Turns texts into rows of ``FEATURES``; kept results per word make it cheap."""

    def __init__(self, lexicon: dict[bytes, float]):
        self.lexicon = lexicon
        self.strong = set(sorted(lexicon, key=lambda w: -lexicon[w])[:16])
        self.person = {w.encode() for w in SECOND_PERSON}
        self.kept: dict[int, tuple] = {}

    def _word(self, word: bytes) -> tuple:
        """(weight, strong, person, hidden weight, mixed)"""
        plain = bare(word)
        weight = self.lexicon.get(plain, 0.0)
        mixed = bool(_DIGIT_OR_SIGN.search(plain)) and any(97 <= c < 123 or c >= 128 for c in plain)
        hidden = 0.0
        if not weight and (mixed or _DIGIT_OR_SIGN.search(word)):
            hidden = self.lexicon.get(unhidden(word.lower()), 0.0) or self.lexicon.get(unhidden(plain), 0.0)
        return (weight, plain in self.strong, plain in self.person, hidden, mixed)

    def rows(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        words = Words(buf, offs)
        n = len(offs) - 1
        out = np.zeros((n, len(FEATURES)))
        if len(words):
            h = words.hashes()
            uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
            info = np.array([self._known(words, i, int(k)) for k, i in zip(uniq, first)], np.float64).reshape(-1, 5)
            per = info[back]
            hit = (per[:, 0] > 0) | (per[:, 3] > 0)
            person = np.flatnonzero(per[:, 2] > 0)
            near = np.zeros(len(words))
            for i in np.flatnonzero(hit):
                a, b = np.searchsorted(person, [i - NEAR, i + NEAR + 1])
                near[i] = float(np.any(words.doc[person[a:b]] == words.doc[i]))
            length = words.end - words.start
            count = words.counts()
            many = np.maximum(count, 1)

            def total(x):
                return np.bincount(words.doc, weights=x, minlength=n)

            kinds = np.unique(np.stack([words.doc[hit], back[hit]]), axis=1)
            out[:, 0] = total(per[:, 0]) / many
            out[:, 1] = total(per[:, 1]) / many
            out[:, 2] = np.log1p(np.bincount(kinds[0], minlength=n))
            out[:, 3] = total(near) / many
            out[:, 4] = total(per[:, 2]) / many
            out[:, 5] = total(per[:, 3]) / many
            out[:, 6] = total(per[:, 4]) / many
            out[:, 7] = total(length == 1) / many
            out[:, 13] = total(length) / many
            out[:, 14] = np.log1p(count)
            upper = (buf >= 65) & (buf < 91)
            ups = np.concatenate([[0], np.cumsum(upper)])
            out[:, 9] = total((ups[words.end] - ups[words.start] == length) & (length > 1)) / many

        def share(mask):
            c = np.concatenate([[0], np.cumsum(mask)])
            return (c[offs[1:]] - c[offs[:-1]]) / np.maximum(np.diff(offs), 1)

        out[:, 8] = share((buf >= 65) & (buf < 91))
        out[:, 10] = share(buf == 33)
        out[:, 11] = share(buf == 63)
        out[:, 12] = share(_EDGE[buf])
        return out

    def _known(self, words: Words, i: int, key: int) -> tuple:
        got = self.kept.get(key)
        if got is None:
            got = self._word(words.text(i))
            if len(self.kept) < 100_000:
                self.kept[key] = got
        return got


# ---- gradient-boosted trees in numpy -------------------------------------------------------

@dataclass
class Trees:
    """Complete trees: ``feature`` and ``cut`` of inner nodes (a row goes right if its value
    is above the cut), ``leaf`` values, and the isotonic map from margin to probability."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float
    margins: np.ndarray
    levels: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += v[at - (2**DEPTH - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; within a flat step the margin still orders rows."""
        m = self.margin(x)
        flat = np.interp(m, self.margins, self.levels)
        return np.clip(0.998 * flat + 0.002 / (1 + np.exp(-np.clip(m, -30, 30))), 0.0, 1.0)


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = TREES) -> Trees:
    """Logistic boosting on binned features with second-order leaf values."""
    n, n_features = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(n_features)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    rate = np.average(y, weights=w)
    base = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
    out = Trees(np.zeros((trees, 2**DEPTH - 1), np.int64), np.full((trees, 2**DEPTH - 1), np.inf),
                np.zeros((trees, 2**DEPTH)), base, np.array([0.0]), np.array([0.0]))
    m = np.full(n, base)
    for t in range(trees):
        p = _sigmoid(m)
        g, h = w * (y - p), w * p * (1 - p) + 1e-12
        at = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            for node in range(2**depth - 1, 2**(depth + 1) - 1):
                mine = np.flatnonzero(at == node)
                best, gain_of = None, 1e-9
                if len(mine) and w[mine].sum() >= 2 * MIN_WEIGHT:
                    G, H = g[mine].sum(), h[mine].sum()
                    for j in range(n_features):
                        if not len(cuts[j]):
                            continue
                        k = len(cuts[j]) + 1
                        gl = np.cumsum(np.bincount(binned[mine, j], g[mine], k))[:-1]
                        hl = np.cumsum(np.bincount(binned[mine, j], h[mine], k))[:-1]
                        wl = np.cumsum(np.bincount(binned[mine, j], w[mine], k))[:-1]
                        gain = gl**2 / (hl + 1) + (G - gl)**2 / (H - hl + 1) - G**2 / (H + 1)
                        gain[(wl < MIN_WEIGHT) | (w[mine].sum() - wl < MIN_WEIGHT)] = 0
                        b = int(np.argmax(gain))
                        if gain[b] > gain_of:
                            best, gain_of = (j, b), gain[b]
                if best:
                    j, b = best
                    out.feature[t, node], out.cut[t, node] = j, cuts[j][b]
                    at[mine] = 2 * node + 1 + (binned[mine, j] > b)
                else:
                    at[mine] = 2 * node + 1
        leaf = at - (2**DEPTH - 1)
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        out.leaf[t] = value
        m += value[leaf]
    return out


def isotonic(m: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (margins, levels) to interpolate between."""
    order = np.argsort(m, kind="stable")
    blocks: list[list[float]] = []  # level, weight, weighted margin
    for mi, yi, wi in zip(m[order], y[order], w[order]):
        blocks.append([yi, wi, mi * wi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, b, c = blocks.pop()
            u, a, d = blocks[-1]
            blocks[-1] = [(u * a + v * b) / (a + b), a + b, c + d]
    return np.array([c / b for _, b, c in blocks]), np.array([v for v, _, _ in blocks])


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray, splits: int = 4) -> Trees:
    """Trees on all rows; the calibration comes from margins of trees that did not see the
    row (``splits``-fold)."""
    if len(y) == 0 or y.min() == y.max():  # nothing to tell apart
        constant = boost(np.zeros((1, len(FEATURES))), np.zeros(1), np.ones(1), 1)
        constant.levels = np.array([float(y.mean()) if len(y) else 0.0])
        return constant
    group = np.arange(len(y)) % splits
    margin = np.zeros(len(y))
    for k in range(splits):
        test = group == k
        if y[~test].min() == y[~test].max():
            continue
        margin[test] = boost(x[~test], y[~test], w[~test]).margin(x[test])
    out = boost(x, y, w)
    out.margins, out.levels = isotonic(margin, y, w)
    return out


# ---- on Spark ------------------------------------------------------------------------------

def _word_shares(texts: DataFrame) -> DataFrame:
    """word, toxic, n: in how many texts each bare word occurs; texts with the same smallest
    shingle hash count once (near copies mostly share it)."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, flags, keys, bags = b.column("toxic").to_pylist(), [], [], []
            for at, to, buf, offs in text_chunks(b.column("text")):
                found = Words(LOWER[buf], offs)
                grams, first = window_hashes(found, found.hashes(), 5)
                cut = np.searchsorted(first, found.first)
                for i in range(to - at):
                    a, z = found.first[i], found.first[i + 1]
                    g = grams[cut[i]:cut[i + 1]]
                    whole = b" ".join(found.text(j) for j in range(a, z))  # a text too short for word runs is its own key
                    keys.append(int(g.min().view(np.int64)) if len(g) else
                                int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little", signed=True))
                    flags.append(ids[at + i])
                    bags.append(sorted(w.decode() for w in {bare(found.text(j)) for j in range(a, z)} if w))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(flags, pa.int32()),
                                              pa.array(bags, pa.list_(pa.string()))], names=["key", "toxic", "bag"])

    bags = texts.select("toxic", "text").mapInArrow(words, "key long, toxic int, bag array<string>")
    once = bags.groupBy("key", "toxic").agg(F.min("bag").alias("bag"))  # of near copies the smallest: no layout matters
    return (once.select("toxic", F.explode("bag").alias("word")).groupBy("word")
            .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")))


def learn_lexicon(texts: DataFrame, size: int = LEXICON) -> dict[bytes, float]:
    """The ``size`` words with the largest smoothed log-odds of their shares among toxic and
    other texts, at least 3 toxic texts each."""
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    odds = F.log(((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1)))
    rows = (_word_shares(texts).filter("bad >= 3").select("word", odds.alias("odds"), "bad")
            .filter("odds > 1.5").orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "word").limit(size).collect())
    return {r["word"].encode(): float(r["odds"]) for r in rows}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, rest: int = 2
        ) -> tuple[dict[bytes, float], Trees]:
    """Lexicon and trees from labelled rows outside the kept fold.  A document with several
    labels counts as toxic if one of them says so; null labels and ids are left out."""
    rows = (labels.filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), folds) != rest))
            .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    chosen = bounded_sample(rows, "toxic", sample)  # at most 2 * sample small rows
    texts = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
             .select("toxic", "weight", F.coalesce("text", F.lit("")).alias("text")))
    texts = texts.persist()
    try:
        lexicon = learn_lexicon(texts)

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn = Features(lexicon)
            for b in batches:
                x = [turn.rows(buf, offs) for _, _, buf, offs in text_chunks(b.column("text"))]
                x = np.concatenate(x) if x else np.empty((0, len(FEATURES)))
                yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("weight"),
                                                  pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "weight", "x"])

        got = texts.mapInArrow(features, "toxic int, weight double, x array<double>").toPandas()
    finally:
        texts.unpersist()
    got = got.sort_values(["toxic", "x"], key=lambda c: c if c.name == "toxic" else c.map(tuple), ignore_index=True)
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return lexicon, train(x, got["toxic"].to_numpy(np.float64), got["weight"].to_numpy(np.float64))


def score(docs: DataFrame, lexicon: dict[bytes, float], trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus score and predicted (columns of these names are replaced)."""
    keep = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, trees))  # LEXICON words, TREES trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, trees = shared.value
        turn = Features(lexicon)
        for b in batches:
            s = [trees.score(turn.rows(buf, offs)) for _, _, buf, offs in text_chunks(b.column("text"))]
            s = np.concatenate(s) if s else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()),
                                              pa.array((s >= threshold).astype(np.int32))],
                                             names=[*b.schema.names, "score", "predicted"])

    return keep.mapInArrow(run, extended(keep, score="double", predicted="int"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, rest: int = 2, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.  A null text is scored as
    an empty one; repeated rows stay; without labels of both kinds every score is the share
    of toxic labels (0 without any); extra columns are ignored."""
    lexicon, trees = fit(docs, labels, folds=folds, rest=rest, **options)
    rows = docs.select("doc_id", held_out(F.col("doc_id"), folds, rest).alias("held_out"), "text")
    return score(rows, lexicon, trees).drop("text")
