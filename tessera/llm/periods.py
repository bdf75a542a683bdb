"""Periodic runs of words by string synchronising sets.

A run is a stretch of consecutive words of one text with smallest period q (words q apart are
equal), at least ``max(6, 4 q)`` words long, that no neighbouring word extends.  All runs of
all texts are found; the work per text is proportional to its words times the logarithm of
their number.

* Small periods (below 8): positions where words q apart are equal, straight from the words.
* For every t = 8, 16, 32, ... the periods t <= q < 2 t.  Every window of t words has an
  identifier (a hash of its words).  A position i is *synchronising* when the smallest
  identifier among the windows i .. i + t is that of the first or the last of them; windows
  with a period of t / 4 at most take no part (they lie in runs that the smaller scales have
  found, and would make every position of such a region synchronising).  Whether i is one
  depends on the 2 t words from i only, so equal contexts of 2 t words agree on it.

  In a run of period q (t <= q < 2 t) one of its first t positions, s, is synchronising:
  else all windows there had periods of t / 4 at most, and so would the run (Fine and Wilf).
  s + q has the same context, which still lies in the run (s + q + 2 t <= 4 q words from its
  start), and no position between has it (2 t > q, and a rotation of a primitive word differs
  from it).  So *neighbours among the positions of equal context* propose every period.
* A proposal counts if the next 2 q words repeat, too; then its stretch is extended word by
  word, and the smallest period of a stretch stays.

Words are compared by 64-bit hashes; two different ones among n distinct words collide
somewhere with probability of about n^2 / 2^65."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, extended, masked, mix, text_chunks

SHORTEST = 6  # words of the shortest run
REPEATS = 4  # a run is at least so many periods long
SMALL = 8  # periods below are compared directly
RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"

_LEFT, _RIGHT = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _shifted(a: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full(len(a), fill, a.dtype)
    out[:len(a) - by] = a[by:]
    return out


def _doubled(ids: np.ndarray, t: int) -> np.ndarray:
    """Identifiers of windows of 2 t words from those of t words (the last ones of a text
    reach over its end and are not used)."""
    return mix(ids * _LEFT + _shifted(ids, t, 0) * _RIGHT)


def _small_periods(h: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, period) of the stretches with the periods below ``SMALL``."""
    out = []
    for q in range(1, SMALL):
        if len(h) <= q:
            break
        at = np.flatnonzero((h[q:] == h[:-q]) & (doc[q:] == doc[:-q]))
        if not len(at):
            continue
        cut = np.flatnonzero(np.diff(at) != 1) + 1
        start = at[np.concatenate([[0], cut])]
        end = at[np.concatenate([cut - 1, [len(at) - 1]])] + 1 + q
        long = end - start >= max(SHORTEST, REPEATS * q)
        out.append((start[long], end[long], np.full(int(long.sum()), q)))
    return out


def _synchronising(ids: np.ndarray, t: int) -> np.ndarray:
    """Positions whose first or last of the windows i .. i + t has the smallest identifier."""
    least, step = ids, 1
    while step < t:
        least = np.minimum(least, _shifted(least, step, _NONE))
        step *= 2
    last = _shifted(ids, t, _NONE)
    least = np.minimum(least, last)
    return np.flatnonzero((least != _NONE) & ((ids == least) | (last == least)))


def _stretch(h: np.ndarray, s: int, q: int, low: int, high: int) -> tuple[int, int]:
    """The longest stretch around ``s`` of words equal to those ``q`` on, within a text."""
    def equal(a: int, b: int) -> np.ndarray:
        return h[a:b] == h[a + q:b + q]

    end, step = s, 64
    while end < high - q:
        to = min(end + step, high - q)
        same = equal(end, to)
        if not same.all():
            end += int(same.argmin())
            break
        end, step = to, step * 2
    start, step = s, 64
    while start > low:
        to = max(start - step, low)
        same = equal(to, start)[::-1]
        if not same.all():
            start -= int(same.argmin())
            break
        start, step = to, step * 2
    return start, end + q


def find_runs(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period; ``h`` are the words' hashes,
    ``first`` the position of each text's first word and, at last, their number."""
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    found = _small_periods(h, doc)
    t, ids, at = 1, h, np.arange(len(h))  # ``at``: the words (of long enough texts) that ids stand for
    while len(at):
        if t >= SMALL:
            found.append(_at_scale(h, first, doc, ids, at, t, found))
        more = size[doc[at]] >= REPEATS * max(2 * t, SMALL)
        ids = _doubled(ids, t)[more]
        at, t = at[more], 2 * t
    start, end, period = (np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]).astype(np.int64) for i in range(3))
    order = np.lexsort([period, end, start])
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # the smallest period of a stretch
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort([period, start])
    return start[order], end[order], period[order]


def _at_scale(h, first, doc, ids, at, t, found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches with periods from t to 2 t - 1."""
    end_of = first[doc[at] + 1]
    windows = np.where(at + t <= end_of, ids, _NONE)
    for start, end, period in found:
        known = (period <= t // REPEATS) & (end - start >= t)
        if known.any():
            edge = np.zeros(len(at) + 1, np.int64)
            np.add.at(edge, np.searchsorted(at, start[known]), 1)
            np.add.at(edge, np.searchsorted(at, end[known] - t + 1), -1)
            windows[np.cumsum(edge[:-1]) > 0] = _NONE
    sync = _synchronising(windows, t)
    sync = sync[at[sync] + 2 * t <= end_of[sync]]
    context = _doubled(ids, t)
    order = np.argsort(context[sync], kind="stable")
    s = sync[order]
    near, gap = s[:-1], np.diff(s)
    good = (context[near] == context[s[1:]]) & (gap >= t) & (gap < 2 * t)
    near, gap = near[good], gap[good]
    # one text, and the 2 q words from there are those q on (two windows of 2 t words cover them)
    good = at[near] + 3 * gap <= end_of[near]
    near, gap = near[good], gap[good]
    far = near + 2 * gap - 2 * t
    good = (context[far] == context[far + gap])
    near, gap = at[near[good]], gap[good]
    out, last = [], (-1, -1)  # (period, end of its last stretch)
    for i in np.lexsort([near, gap]).tolist():
        s, q = int(near[i]), int(gap[i])
        if last[0] == q and s < last[1] - q:
            continue  # the same stretch again
        a, b = _stretch(h, s, q, int(first[doc[s]]), int(first[doc[s] + 1]))
        last = (q, b)
        if b - a >= max(SHORTEST, REPEATS * q):
            out.append((a, b, q))
    return tuple(np.array(x, np.int64) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start and length in words, period; by start, then
    period) and ``collapsed``: the words that no run holds after its first q words, joined by
    one space.

    A null text has no words, no runs and an empty ``collapsed``.  Every row is looked at by
    itself, so null ids and repeated rows do not matter; an empty table gives no rows; columns
    of these three names are replaced, all others stay.  No row leaves its task and nothing
    is shuffled; a text is worked on whole, whatever its length."""
    rows, name = masked(docs.drop("n_words", "runs", "collapsed"))
    column = name[text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, offsets, parts, left = [], [0], [], []
            texts = b.column(column)
            for lo, hi, buf, offs in text_chunks(texts):
                words = Words(buf, offs)
                first = words.first
                start, end, period = find_runs(words.hashes(), first)
                counts.append(words.counts())
                which = words.doc[start]
                parts.append((start - first[which], end - start, period))
                cuts = np.searchsorted(which, np.arange(hi - lo + 1))
                offsets += (offsets[-1] + cuts[1:]).tolist()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, end, -1)
                kept = np.cumsum(edge[:-1]) == 0
                for i in range(hi - lo):
                    its = buf[offs[i]:offs[i + 1]].tobytes().split()
                    if cuts[i + 1] > cuts[i]:
                        its = compress(its, kept[first[i]:first[i + 1]].tolist())
                    left.append(b" ".join(its))
            columns = [np.concatenate([p[i] for p in parts] or [np.empty(0, np.int64)]) for i in range(3)]
            runs = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["start", "length", "period"]))
            n = pa.array(np.concatenate(counts or [np.empty(0, np.int64)]), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n, runs, pa.array(left, pa.binary()).cast(pa.string())],
                                             names=[*b.schema.names, "n_words", "runs", "collapsed"])

    schema = extended(rows, n_words="bigint", runs=RUN_TYPE, collapsed="string")
    return rows.mapInArrow(run, schema).toDF(*name, "n_words", "runs", "collapsed")


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every run cut to its first period.  A text without runs stays as it is (a
    null one is null); of another the kept words are joined by one space.  ``n_chars`` (if
    there) is brought up to date."""
    plain, name = masked(docs)
    column = name[text]
    found = periodic_runs(plain, column)
    cut = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(column))
    out = found.withColumn(column, cut).select(*plain.columns)
    if "n_chars" in name:
        out = out.withColumn(name["n_chars"], F.char_length(F.coalesce(column, F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)


def run_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; nulls without
    runs) with 1000 times its exponent, and SHA-256 digests of the list of runs
    (``start,length,period`` and a line feed each) and of the collapsed text."""
    found = periodic_runs(docs.select("doc_id", text), text)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                   F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"),
                                                              r["period"].alias("period"))))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start",
                    (-F.col("best.minus")).alias("length"), "best.period",
                    F.expr("(1000 * -best.minus) div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


def with_planted_run(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where h = crc32(doc_id as text) is a multiple of 10, the words from
    number a = g mod n on repeat with period p = 1 + (n - a) div (3 + g mod 8), g = h div 10.
    Other texts stay as they are, so do those without id or words."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), (h % 10 == 0).alias("chosen"))
    cut = chosen.withColumn("w", F.when(F.col("chosen"), words))
    cut = cut.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    cut = cut.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast((n - a + p - 1) div p as int)))), 1, n)")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
