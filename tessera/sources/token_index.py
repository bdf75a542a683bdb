"""Token offsets of a subword tokenizer, one index per text: two arrays beside the text, so the
tokens of a text are found once and positions are looked up in the JVM, without a shuffle.

Where a vocabulary splits a text into words that no merge crosses (``WordIds`` looks), a word has the
same tokens wherever it stands: a worker keeps the offsets inside words it has seen and asks the
library for new words only.  With any other vocabulary the library gets whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

VOCABULARY = "word_bpe_49k.json"  # a public vocabulary; another file is a parameter
AT_ONCE = 256  # texts that are indexed together; equal ones among them once
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEEP = 300_000  # words whose offsets a worker keeps, at most


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Offsets:
    """(first character, the one after the last) of every token of a text, as rows of an array."""

    def __init__(self, path: str, keep: int = KEEP):
        from ..llm.tokenizers_cached import WordIds

        library = WordIds(path)
        self.tokenizer, self.by_word = library.tokenizer, library.by_word
        self.keep = keep
        self.words: dict[str, bytes] = {}

    def direct(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int32).reshape(-1, 2)

    def _new_words(self, words: list[str]) -> dict[str, bytes]:
        """The offsets inside each of some words, which the library gets together."""
        tokens = self.direct(" ".join(words))
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        first = np.cumsum(sizes) - sizes
        cuts = np.searchsorted(tokens[:, 0], np.append(first, sizes.sum())).tolist()
        tokens = tokens - np.repeat(first, np.diff(cuts)).astype(np.int32)[:, None]
        return {w: tokens[i:j].tobytes() for w, i, j in zip(words, cuts, cuts[1:])}

    def of(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [self.direct(t) for t in texts]
        split = [WORD.findall(t) for t in texts]
        known = self.words
        new = self._new_words(list({w for words in split for w in words if w not in known}))
        if len(known) + len(new) <= self.keep:
            known.update(new)
        out = []
        for t, words in zip(texts, split):
            parts = [known[w] if w in known else new[w] for w in words]
            first = np.array([m.start() for m in WORD.finditer(t)], np.int32)
            inside = np.frombuffer(b"".join(parts), np.int32).reshape(-1, 2)
            out.append(inside + np.repeat(first, [len(p) // 8 for p in parts])[:, None])
        return out


def with_token_index(df: DataFrame, text: str = "context", path: str | None = None) -> DataFrame:
    """``df`` with ``token_starts`` and ``token_ends``: per token of the whole text, in order, its
    first character and the one after its last (code points), without special tokens.  A null text
    has null arrays, an empty one empty arrays.  ``path``: a file of the library ``tokenizers``."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..llm.tokenizers_cached import loaded

        offsets = loaded(Offsets, path)
        for b in batches:
            for lo in range(0, b.num_rows, AT_ONCE):
                part = b.slice(lo, AT_ONCE)
                texts = part.column(text).to_pylist()
                different = list({t for t in texts if t is not None})
                found = dict(zip(different, offsets.of(different)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(_lists([None if t is None else found[t][:, i] for t in texts]) for i in (0, 1))],
                    names=[*part.schema.names, "token_starts", "token_ends"])

    own = [StructField(c, ArrayType(IntegerType())) for c in ("token_starts", "token_ends")]
    return df.mapInArrow(run, StructType([*df.schema.fields, *own]))


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    ends = np.cumsum([0 if r is None else len(r) for r in rows])
    starts = [None if r is None else int(e) - len(r) for r, e in zip(rows, ends)]
    values = np.concatenate([np.empty(0, np.int32), *(r for r in rows if r is not None)])
    return pa.ListArray.from_arrays(pa.array([*starts, int(ends[-1]) if rows else 0], pa.int32()), pa.array(values, pa.int32()))
