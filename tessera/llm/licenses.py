"""License scan by ordered signature rules.

Every text is brought to its normal form: its words (letters A-Z lower-cased) joined by one
space.  A rule of ``license_rules`` is tried on a text only if the text holds all the rule's
keywords: the words' hashes are looked up in the sorted hashes of all keywords, for many texts
at once, so a text without keywords costs no regular expression at all.

Detections that overlap are resolved in order: by group of rules (its priority), then the
longer one, then the earlier one in the text, then the earlier rule.  A detection goes when
one that stays contains it, or overlaps it and is of a higher priority.  Sure phrases (``PHRASES``)
are looked for beside the rules; nothing suppresses them."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_TERM, LOWER, Words, extended, joined, masked, text_chunks
from .license_rules import GROUPS, WEIGHTS

# --- fixed values: phrases and their labels -------------------------------------------------
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"),
           ("mit license", "mit"))
# ---------------------------------------------------------------------------------------------
HIT_TYPE = "array<struct<label:string,priority:int,rule:int,start:bigint,end:bigint,weight:double>>"
PHRASE_TYPE = "array<struct<label:string,start:bigint>>"

#: letters to lower case, bytes outside words to spaces
_NORMAL = bytes(int(LOWER[c]) if IS_TERM[c] else 32 for c in range(256))


def _whole(pattern: str) -> re.Pattern:
    """``pattern`` from the start of a word to the end of one."""
    return re.compile(f"(?:{pattern})(?= )")


@lru_cache(maxsize=1)
def compiled() -> tuple[list, list, np.ndarray]:
    """(rules, phrases, sorted keyword hashes).  A rule: (keyword numbers, group, number,
    label, pattern, weight); a phrase: (keyword numbers, label, pattern)."""
    words = sorted({w for g in GROUPS for _, keys, _ in g for w in keys.split()} | {w for p, _ in PHRASES for w in p.split()})
    hashes = Words(*joined([w.encode() for w in words]), IS_TERM).hashes()
    order = np.argsort(hashes)
    number = {words[j]: i for i, j in enumerate(order.tolist())}
    rules, n = [], 0
    for level, (group, weight) in enumerate(zip(GROUPS, WEIGHTS)):
        for label, keys, pattern in group:
            rules.append((frozenset(number[w] for w in keys.split()), level, n, label, _whole(pattern), weight))
            n += 1
    phrases = [(frozenset(number[w] for w in p.split()), label, _whole(p)) for p, label in PHRASES]
    return rules, phrases, hashes[order]


def _places(pattern: re.Pattern, normal: str, starts: list[int]) -> Iterator[tuple[int, int]]:
    """(first word, word after the last) of every match that begins at a word."""
    at = 0
    while (m := pattern.search(normal, at)) is not None:
        i = bisect_left(starts, m.start())
        if i < len(starts) and starts[i] == m.start():
            yield i, bisect_left(starts, m.end())
            at = m.end()
        else:
            at = m.start() + 1


def resolve(hits: list[tuple]) -> list[tuple]:
    """The detections (start, end, group, rule, ...) that stay, in the order of the text.

    Those that stay never contain each other; sorted by start they are sorted by end, too, so
    only neighbours can overlap a new one."""
    stays: list[tuple] = []
    for hit in sorted(hits, key=lambda h: (h[2], h[0] - h[1], h[0], h[3])):
        start, end, group = hit[:3]
        after = bisect_left(stays, (start + 1,))
        lost, i = False, after - 1
        while i >= 0 and stays[i][1] > start and not lost:  # those that begin at or before the start
            lost, i = stays[i][1] >= end or stays[i][2] < group, i - 1
        i = after
        while i < len(stays) and stays[i][0] < end and not lost:
            lost, i = stays[i][2] < group, i + 1
        if not lost:
            insort(stays, hit)
    return stays


def scan_text(text: bytes, present: frozenset[int]) -> tuple[list[tuple], list[tuple[str, int]]]:
    """(detections, places of the phrases) of one text, whose keywords are ``present``."""
    rules, phrases, _ = compiled()
    wanted = [r for r in rules if r[0] <= present]
    sure = [p for p in phrases if p[0] <= present]
    if not wanted and not sure:
        return [], []
    words = text.translate(_NORMAL).split()
    normal = b" ".join([*words, b""]).decode()
    lengths = [len(w.decode()) + 1 for w in words] if len(normal) != sum(map(len, words)) + len(words) else [len(w) + 1 for w in words]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).tolist()
    hits = [(a, b, group, n, label, weight) for _, group, n, label, pattern, weight in wanted
            for a, b in _places(pattern, normal, starts)]
    places = sorted((a, label) for _, label, pattern in sure for a, _ in _places(pattern, normal, starts))
    return resolve(hits), [(label, a) for a, label in places]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``licenses`` (the detections that stay: label, priority, rule,
    first word, word after the last, weight) and ``phrases`` (label and first word of every
    place of a sure phrase), in the order of the text, words numbered from 0.

    A null text has no words.  Rows are looked at one by one: null ids, ties and repeated rows
    do not matter, an empty table gives no rows.  Columns of these three names are replaced,
    all others stay.  Texts are scanned whole; nothing is shuffled."""
    rows, name = masked(docs.drop("n_words", "licenses", "phrases"))
    column = name[text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = compiled()[2]
        for b in batches:
            counts, hits, places = [], [], []
            for lo, hi, buf, offs in text_chunks(b.column(column)):
                words = Words(LOWER[buf], offs, IS_TERM)
                counts.append(words.counts())
                h = words.hashes()
                slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                at = np.flatnonzero(keys[slot] == h)
                found: dict[int, set[int]] = {}
                for d, k in zip(*np.unique(np.stack([words.doc[at], slot[at]]), axis=1).tolist()):
                    found.setdefault(d, set()).add(k)
                for i in range(hi - lo):
                    a, z = scan_text(buf[offs[i]:offs[i + 1]].tobytes(), frozenset(found[i])) if i in found else ([], [])
                    hits.append([{"label": label, "priority": group, "rule": n, "start": s, "end": e, "weight": w}
                                 for s, e, group, n, label, w in a])
                    places.append([{"label": label, "start": s} for label, s in z])
            schema = pa.schema([
                ("licenses", pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("rule", pa.int32()),
                                                 ("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))),
                ("phrases", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())])))])
            n = pa.array(np.concatenate(counts or [np.empty(0, np.int64)]), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n, pa.array(hits, schema.field(0).type), pa.array(places, schema.field(1).type)],
                                             names=[*b.schema.names, "n_words", "licenses", "phrases"])

    schema = extended(rows, n_words="bigint", licenses=HIT_TYPE, phrases=PHRASE_TYPE)
    return rows.mapInArrow(run, schema).toDF(*name, "n_words", "licenses", "phrases")


def license_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base (places of the sure phrases) with the first words of the first
    and the last of them (nulls without any), base_labels, labels (those of the detections
    that stay, too; both distinct, sorted, comma-joined) and score: one minus the product of
    ``1 - weight`` over the distinct labels' best detections, 0 without any."""
    found = scan(docs.select("doc_id", text), text)
    starts = F.col("phrases.start")
    base, own = F.col("phrases.label"), F.col("licenses.label")

    def text_of(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    best = F.transform(F.array_distinct(own), lambda x: F.array_max(F.transform(
        F.filter("licenses", lambda r: r["label"] == x), lambda r: r["weight"])))
    doubt = F.aggregate(best, F.lit(1.0), lambda a, w: a * (1.0 - w))
    return found.select("doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
                        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        text_of(base).alias("base_labels"), text_of(F.concat(base, own)).alias("labels"),
                        (1.0 - doubt).alias("score"))
