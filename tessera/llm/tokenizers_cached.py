"""Token ids and counts of whole texts, by the libraries themselves, faster than text by text.

Two vocabularies split a text into parts that no merge crosses, so a part has the same tokens
wherever it stands and its result can be kept for the next text:

* ``PieceCounter`` (sentencepiece BPE with identity normalisation): no piece holds a space
  mark after another character, nor a line feed, so merges never cross the start of a
  space-led word or a line feed.
* ``WordIds`` (BPE with word ends, white space dropped): the words between ASCII white space
  are independent.

Both look at their vocabulary first; with any other kind of vocabulary the library gets whole
texts.  A part that is not kept yet is given to the library.
``tests/llm/test_sketches_tokens_packing.py`` holds both against the library on whole texts.  Each keeps at most a fixed number of parts."""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import public_tokenizers

KEEP = 300_000


def vocabulary(name: str) -> str:
    """The file of a public vocabulary."""
    return public_tokenizers.path(name)


def version_digest(path: str, library: str) -> str:
    """Identifies what decides a count: the library, its version and the vocabulary file."""
    from importlib.metadata import version

    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {version(library)} ".encode() + f.read()).hexdigest()


def _kept(make, keep: int) -> dict:
    """A dictionary that makes a missing value and keeps at most ``keep`` of them."""

    class Kept(dict):
        def __missing__(self, key):
            value = make(key)
            if len(self) < keep:
                self[key] = value
            return value

    return Kept()


class PieceCounter:
    """Number of sentencepiece tokens of a text."""

    def __init__(self, path: str, keep: int = KEEP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: whether parts of a text are independent (see above); else whole texts are encoded
        self.by_word = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and all(
            self.model.decode(self.model.encode(t)) == t for t in ("a  b", " a ", "ﬁ\n é"))
        self.words = _kept(self._lines, keep)
        self.lines: dict[str, int] = {}
        self.keep = keep

    def direct(self, text: str) -> int:
        return len(self.model.encode(text))

    def _lines(self, part: str) -> int:
        if "\n" not in part:
            return self.direct(part)
        head, *rest = part.split("\n")
        total = self.words[head] if head else 1  # the space mark alone
        for line in rest:  # a line feed, then the line without a space mark
            n = self.lines.get(line)
            if n is None:
                n = self.direct("\n" + line) - 1
                if len(self.lines) < self.keep:
                    self.lines[line] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if not self.by_word or "  " in text or "▁" in text or text[:1] == " " or text[-1:] == " ":
            return self.direct(text)
        return sum(map(self.words.__getitem__, text.split(" "))) if text else 0


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level BPE writes each byte: printable Latin-1 characters
    stand for themselves, the others for U+0100 onwards in byte order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of a text as little-endian 32-bit bytes, without added special tokens."""

    # On these characters lower-casing and composition are the plain ones; a text with any
    # other (or the start of a special token) goes to the library word by word.
    PLAIN = re.compile("[\\x20\\x09-\\x0D!-~À-ÖØ-öø-ÿŒœ]*")
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]"
                       "|[^\\x20\\x09-\\x0Da-z0-9ß-öø-ÿœ]+")

    # What a vocabulary file has to say for its words to be independent and for PARTS to be
    # its split; its added tokens start like PLAIN expects.
    SETTINGS = {
        "normalizer": {"type": "Sequence", "normalizers": [
            {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "behavior": "Removed", "invert": True, "pattern": {
                "Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    }
    MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
             "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}

    def __init__(self, path: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()  # texts are whole, whatever the file says
        self.tokenizer.no_padding()
        said = json.loads(self.tokenizer.to_str())
        #: whether words are independent (see above); else whole texts are encoded
        self.by_word = (
            all(said.get(k) == v for k, v in self.SETTINGS.items())
            and {k: v for k, v in said["model"].items() if k not in ("vocab", "merges")} == self.MODEL
            and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"])
                    and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in said["added_tokens"]))
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words = _kept(lambda word: self.direct(word.decode()), keep)
        self.parts = _kept(self._part, 2 * keep)

    def direct(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else "".join(self.letters[b] for b in part.encode())
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self.direct(text)
        if "<|" not in text and self.PLAIN.fullmatch(text):
            return b"".join(map(self.parts.__getitem__, self.PARTS.findall(text.lower())))
        return b"".join(map(self.words.__getitem__, text.encode().split()))


_LOADED: dict = {}


def loaded(kind: type, path: str):
    """One instance per Python worker, so its kept parts serve all of a worker's tasks."""
    if (kind.__name__, path) not in _LOADED:
        _LOADED[kind.__name__, path] = kind(path)
    return _LOADED[kind.__name__, path]
