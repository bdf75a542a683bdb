"""Language identification by multilingual mixture inference.

Each language has a distribution over byte trigrams of lower-cased words (with their word
borders), learned from a bounded sample of labelled rows.  A text is a mixture: every word
comes from one language of a set, with proportions that expectation-maximisation estimates
from the words' n-gram likelihoods.  The set is the one of the nested sets by falling
proportion, of one to all languages, that has the best penalised likelihood; the prediction
is its largest part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks
from .sampling import bounded_sample, fold, held_out

FOLDS = 4
SAMPLE = 1500  # labelled rows of a language, at most
BITS = 16  # trigram buckets
SMOOTHING = 0.1
STEPS = 12  # expectation-maximisation steps over all languages
SET_STEPS = 6  # and over each smaller set
PENALTY = 2.0  # times log(words) for every further language of a set
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)  # a-z and every byte of a multi-byte character
_LETTER[97:123] = True
_LETTER[128:] = True


def word_grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket of every letter byte, first letter of every word, word counts of every
    text) of lower-cased texts; a word's trigrams are centred on its letters."""
    letter = _LETTER[buf]
    byte = np.where(letter, buf, 32).astype(np.uint32)
    left = np.empty_like(byte)
    left[1:] = byte[:-1]
    right = np.empty_like(byte)
    right[:-1] = byte[1:]
    filled = np.flatnonzero(offs[1:] > offs[:-1])
    left[offs[:-1][filled]] = 32
    right[offs[1:][filled] - 1] = 32
    code = (left << np.uint32(16)) | (byte << np.uint32(8)) | right
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    at = np.flatnonzero(letter)
    first = np.flatnonzero(left[at] == 32)
    starts = at[first]
    words = np.diff(np.searchsorted(starts, offs))
    return bucket[at], first, words


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def learn(docs: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, rest: int = 2
          ) -> tuple[list[str], np.ndarray]:
    """(languages by code point, log-probability table [bucket, language]) from rows with a
    text and a language outside the kept fold, at most ``sample`` a language."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != rest))
    chosen = bounded_sample(rows, "lang", sample).select("doc_id").distinct()
    texts = rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            lang = np.array(b.column("lang").to_pylist(), dtype=object)
            low = _lower(b.column("text"))
            for name in set(lang.tolist()):
                part = low.filter(pa.array(lang == name))
                for _, _, buf, offs in text_chunks(part):
                    grams, _, _ = word_grams(buf, offs)
                    total[name] = total.get(name, 0) + np.bincount(grams, minlength=1 << BITS)
        for name, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n.astype(np.int64).tolist()], pa.list_(pa.int64()))],
                                             names=["lang", "n"])

    # one row per task and language; summed bucket by bucket on the cluster
    sums = (texts.mapInArrow(count, "lang string, n array<bigint>")
            .select("lang", F.posexplode("n").alias("bucket", "n")).filter("n > 0")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    got = sums.toPandas()
    langs = sorted(got["lang"].unique().tolist())
    table = np.full((1 << BITS, len(langs)), SMOOTHING)
    for j, name in enumerate(langs):
        part = got[got["lang"] == name]
        table[part["bucket"].to_numpy(), j] += part["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32)


def _em(like: np.ndarray, share: np.ndarray, first: np.ndarray, words: np.ndarray, steps: int
        ) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ``steps``, and log-likelihood under them, per text.  ``like`` has a
    row per word (scaled by its largest), ``first`` and ``words`` say where texts lie."""
    for _ in range(steps):
        mixed = like * np.repeat(share, words, axis=0)
        mixed /= mixed.sum(axis=1, keepdims=True) + 1e-300
        share = np.add.reduceat(mixed, first, axis=0) / words[:, None]
    total = (like * np.repeat(share, words, axis=0)).sum(axis=1)
    return share, np.add.reduceat(np.log(total + 1e-300), first)


def infer(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number or -1, share of that language in the mixture of all, size of the set)
    of each lower-cased text."""
    return infer_sets(buf, offs, table)[:3]


def infer_sets(buf: np.ndarray, offs: np.ndarray, table: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``infer``, and each text's proportions in its set (0: not in the set)."""
    n, n_langs = len(offs) - 1, table.shape[1]
    best = np.full(n, -1)
    score = np.zeros(n)
    sizes = np.zeros(n, np.int64)
    shares = np.zeros((n, n_langs))
    grams, starts, words = word_grams(buf, offs)
    some = np.flatnonzero(words > 0)
    if len(some) == 0 or n_langs == 0:
        return best, score, sizes, shares
    log_like = np.add.reduceat(table[grams], starts, axis=0).astype(np.float64)
    words = words[some]
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    like = np.exp(log_like - log_like.max(axis=1, keepdims=True))
    full, total = _em(like, np.full((len(some), n_langs), 1.0 / n_langs), first, words, STEPS)
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    # no proportions whatever exceed this log-likelihood (concavity), so a text whose best set
    # beats it less the penalty of k languages is done: leaving it out changes no choice
    mixed = (like * np.repeat(full, words, axis=0)).sum(axis=1, keepdims=True) + 1e-300
    gain = (np.add.reduceat(like / mixed, first, axis=0) / words[:, None]).max(axis=1)
    limit = total + words * np.log(np.maximum(gain, 1.0))
    pick, value, chosen = order[:, 0].copy(), np.full(len(some), -np.inf), np.ones(len(some), np.int64)
    inside = np.zeros((len(some), n_langs))
    penalty = PENALTY * np.log(words + 1.0)
    open_ = np.arange(len(some))
    for k in range(1, n_langs + 1):
        keep = limit[open_] - penalty[open_] * (k - 1) > value[open_]
        if not keep.any():
            break
        if not keep.all():
            like, open_ = like[np.repeat(keep, words[open_])], open_[keep]
        n_words = words[open_]
        share = np.where(rank[open_] < k, full[open_] + 1e-6, 0.0)
        share /= share.sum(axis=1, keepdims=True)
        share, total = _em(like, share, np.cumsum(n_words) - n_words, n_words, SET_STEPS if k > 1 else 0)
        total = total - penalty[open_] * (k - 1)
        better = total > value[open_]
        at = open_[better]
        value[at], pick[at], chosen[at], inside[at] = total[better], share[better].argmax(axis=1), k, share[better]
    best[some], sizes[some], shares[some] = pick, chosen, inside
    score[some] = full[np.arange(len(some)), pick]
    return best, np.clip(score, 0.0, 1.0), sizes, shares


def identify(docs: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, rest: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_langs (size of the chosen set), langs (the set,
    the largest part first) and proportions (theirs) of every whole text.  A null text and one without a letter get ``und`` with score 0 and no set, as does every text
    if there is nothing to learn from.  Repeated rows stay; ties go to the language that is
    first by code point; extra columns are ignored."""
    langs, table = learn(docs.select("doc_id", "text", "lang"), sample, folds, rest)
    shared = docs.sparkSession.sparkContext.broadcast((langs, table))  # 2^16 rows, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for b in batches:
            parts = [infer_sets(buf, offs, table) for _, _, buf, offs in text_chunks(_lower(b.column("text")))]
            best, score, size, shares = (np.concatenate(x) for x in zip(*parts)) if parts else ([], [], [], [])
            lettered = b.column("lettered").to_pylist()
            known = [ok and k >= 0 for ok, k in zip(lettered, best)]
            sets = [np.argsort(-p, kind="stable")[:s] if ok else [] for ok, p, s in zip(known, shares, size)]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("held_out"),
                pa.array([langs[k] if ok else UNKNOWN for ok, k in zip(known, best)], pa.string()),
                pa.array([float(s) if ok else 0.0 for ok, s in zip(known, score)], pa.float64()),
                pa.array([int(s) if ok else 0 for ok, s in zip(known, size)], pa.int32()),
                pa.array([[langs[j] for j in of] for of in sets], pa.list_(pa.string())),
                pa.array([[float(p[j]) for j in of] for of, p in zip(sets, shares)], pa.list_(pa.float64())),
            ], names=["doc_id", "held_out", "lang_pred", "score", "n_langs", "langs", "proportions"])

    rows = docs.select("doc_id", held_out(F.col("doc_id"), folds, rest).alias("held_out"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_langs int, "
                                "langs array<string>, proportions array<double>")
