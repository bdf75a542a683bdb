"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Tokens are words (A-Z lower-cased) and one end per text.  The model predicts a token's class
from the classes of the two tokens before it: with context vectors ``R``, position weights
``c1, c2``, target vectors ``Q`` and biases ``b``, the score of class ``w`` is
``(R[w1] * c1 + R[w2] * c2) . Q[w] + b[w]``, normalised over all classes by batched matrix
products.  Each of the most frequent words and the end is a class of its own; every other
word belongs to a class that its length and last byte decide.  Inside such a class the words
seen at least ``LEARNED`` times (their number grows with the corpus and has no bound) have
vectors of their own, as contexts and as targets: the class falls into cells of ``CELL``
words, and a word has the probability of its class, times that of its cell in the class, times
its own in the cell, each a log-bilinear softmax of the same context.  Words seen more rarely
share one more cell of their class and have its probability times their smoothed share of it:
``(c + 1) / (sum of c + 1 over them + 1)``, the last 1 standing for the words that were never
seen; as contexts they have their class's vector.

Counts cover every training text.  Training passes over every training text as well: each
task trains on its own texts from the common start, and the models are averaged (classes by
tokens, words and cells by the times a task met them; a sum per block of parameters on the
cluster), once per round.  All rounds but the last train classes only; the last starts every
word from its class's vector.  A table of the most frequent words' counts is broadcast (at
most ``FREQUENT`` words and all learned ones); all other words of all texts meet their counts
in a join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, publish, text_chunks
from .sampling import fold, held_out

FOLDS = 7
FREQUENT = 1 << 18  # words whose counts are broadcast, at most (learned words always are)
LEARNED = 100  # words seen so often have vectors of their own
CELL = 64  # learned words in a cell
OWN = 447  # words that are a class of their own, at most
SHAPES = 64  # classes of the other words
END = OWN + SHAPES  # the class of the end of a text; also stands before its first word
CLASSES = OWN + SHAPES + 1
WIDTH = 16
NOISE = 64
BATCH = 1024
ROUNDS = 2
LEARNING_RATE = 0.04
BLOCKS = 32
NODES = 512  # words and cells in a block of parameters
FEW = 12  # rows of a number that are summed one by one, all numbers together
NOISE_IN = 4  # noise words (or cells) per token inside a cell (or class)
TOGETHER = 1_000_000  # tokens whose contexts are scored together
WIDE, NARROW = 1 << 14, 1 << 9  # second and first words of contexts whose scores are held at a time


def shape_class(words: Words) -> np.ndarray:
    """The class of every word that has none of its own: by length and last byte."""
    length = np.minimum((words.end - words.start - 1) // 2, 7)
    last = words.buf[words.end - 1].astype(np.int64)
    return OWN + 8 * length + (last * 5 % 8)


# ---- counts --------------------------------------------------------------------------------

def count_words(texts: DataFrame) -> DataFrame:
    """(h, c, shape): the count of every distinct word by its hash; each batch is counted
    before it is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, shapes = [], []
            for _, _, buf, offs in text_chunks(b.column("text")):
                words = Words(LOWER[buf], offs)
                hs.append(words.hashes())
                shapes.append(shape_class(words).astype(np.int32))
            if not hs:
                continue
            h, first, n = np.unique(np.concatenate(hs), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(np.concatenate(shapes)[first])],
                                             names=["h", "n", "shape"])

    return (texts.select("text").mapInArrow(run, "h long, n long, shape int")
            .groupBy("h").agg(F.sum("n").alias("c"), F.max("shape").alias("shape")))


@dataclass
class Tree:
    """The learned words below the classes by shape.  Cells are numbered by class, words by
    cell; the first cell of each class is that of its rare words and has no learned ones."""

    cells: np.ndarray  # where the cells of each shape class start, and their number
    words: np.ndarray  # where the words of each cell start, and their number
    cell: np.ndarray  # per word its cell
    shape: np.ndarray  # per word its shape class, from 0
    mass: np.ndarray  # per cell, then per word: sum of c + 1
    rare: np.ndarray  # per shape class: sum of c + 1 over its rare words, plus 1

    @staticmethod
    def of(shape: np.ndarray, c: np.ndarray, sums: np.ndarray) -> Tree:
        """Of learned words sorted by shape class, the frequent ones of a class first."""
        n = np.bincount(shape, minlength=SHAPES)
        cells = np.concatenate([[0], np.cumsum(1 + -(-n // CELL))])
        inside = np.arange(len(shape)) - (np.cumsum(n) - n)[shape]
        cell = cells[shape] + 1 + inside // CELL
        words = np.searchsorted(cell, np.arange(cells[-1] + 1))
        learned = np.bincount(shape, c + 1.0, SHAPES)
        mass = np.bincount(cell, c + 1.0, cells[-1])
        mass[cells[:-1]] = sums - learned
        return Tree(cells, words, cell, shape, np.concatenate([mass, c + 1.0]), sums - learned)

    def places(self, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of shape classes, tokens of learned words, cells of the former, numbers of
        the latter)."""
        shaped, learned = np.flatnonzero((w >= OWN) & (w < END)), np.flatnonzero(x >= CLASSES)
        xs = x[shaped]
        cell = self.cells[w[shaped] - OWN]
        own = np.flatnonzero(xs >= CLASSES)
        cell[own] = self.cell[xs[own] - CLASSES]
        return shaped, learned, cell, x[learned] - CLASSES

    def start(self, model: Model) -> np.ndarray:
        """Per cell, then per word: context vector, target vector and bias.  Every softmax
        starts at the shares, every word's context vector at its class's."""
        n = self.cells[-1]
        out = np.zeros((len(self.mass), 2 * WIDTH + 1), np.float32)
        out[n:, :WIDTH] = model.R[OWN + self.shape]
        total = np.concatenate([np.repeat(np.add.reduceat(self.mass[:n], self.cells[:-1]), np.diff(self.cells)),
                                self.mass[:n][self.cell]])
        out[:, -1] = np.log(self.mass / total)
        return out


@dataclass
class Vocabulary:
    """What every task needs: the frequent words' hashes (sorted), counts, classes (-1: none
    of its own) and numbers among the learned words (-1: not learned), the smallest count
    among them, and the class sums."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    learned: np.ndarray
    tree: Tree
    floor: int
    sums: np.ndarray  # per shape class: sum of c + 1 over its words, plus 1
    tokens: int  # N
    types: int  # V
    ends: int

    def only(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, classes, numbers among the learned words) of some of the words."""
        return self.hashes[keep], self.classes[keep], self.learned[keep]


def vocabulary(counts: DataFrame, ends: int, frequent: int = FREQUENT, learned: int = LEARNED) -> Vocabulary:
    """The broadcast part of the counts.  Frequent are all words with a count of at least the
    smallest power of two that leaves at most ``frequent`` of them, and all learned words."""
    level = F.floor(F.log2("c"))
    steps = {int(r["k"]): r["n"] for r in counts.groupBy(level.alias("k")).agg(F.count("*").alias("n")).collect()}
    total = 0
    floor = 1 << (max(steps, default=0) + 1)
    for k in sorted(steps, reverse=True):
        if total + steps[k] > frequent:
            break
        total, floor = total + steps[k], 1 << k
    floor = min(floor, learned)
    top = counts.filter(F.col("c") >= floor).toPandas().sort_values(["c", "h"], ascending=[False, True])
    shape, c = top["shape"].to_numpy(np.int64) - OWN, top["c"].to_numpy(np.int64)
    own = np.full(len(top), -1)
    own[:OWN] = np.arange(min(OWN, len(top)))
    sums = np.ones(SHAPES)
    seen = 0
    types = 0
    for r in counts.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        sums[r["shape"] - OWN] += r["c"] + r["v"]
        seen, types = seen + r["c"], types + r["v"]
    np.subtract.at(sums, shape[:OWN], c[:OWN] + 1)
    at = np.flatnonzero((own < 0) & (c >= learned))
    at = at[np.argsort(shape[at], kind="stable")]
    number = np.full(len(top), -1)
    number[at] = np.arange(len(at))
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], own[order], number[order], Tree.of(shape[at], c[at], sums), floor, sums,
                      seen + ends, types + (ends > 0), ends)


# ---- the model -----------------------------------------------------------------------------

@dataclass
class Model:
    R: np.ndarray
    Q: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(share: np.ndarray, seed: int = 5) -> Model:
        rng = np.random.Generator(np.random.Philox(seed))
        n = len(share)
        return Model(rng.normal(0, 0.1, (n, WIDTH)), rng.normal(0, 0.1, (n, WIDTH)),
                     np.ones(WIDTH), np.full(WIDTH, 0.5), np.log(share))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.R, self.Q, self.c1, self.c2, self.b)])

    @staticmethod
    def of(flat: np.ndarray, n: int) -> Model:
        a = n * WIDTH
        return Model(flat[:a].reshape(n, WIDTH), flat[a:2 * a].reshape(n, WIDTH), flat[2 * a:2 * a + WIDTH],
                     flat[2 * a + WIDTH:2 * a + 2 * WIDTH], flat[2 * a + 2 * WIDTH:])


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps on batches of tokens; the noise words
    of a batch are shared by its tokens, so their scores are one matrix product.  Works in
    single precision; a bias is one more column of the target vectors."""

    def __init__(self, model: Model, share: np.ndarray, seed: int):
        self.R = model.R.astype(np.float32)
        self.Q = _with_bias(model.Q, model.b)
        self.c = np.stack([model.c1, model.c2]).astype(np.float32)
        self.noise = np.log(share * NOISE).astype(np.float32)
        self.edges = np.cumsum(share)
        self.rng = np.random.Generator(np.random.Philox(seed))
        self.R_sq, self.Q_sq, self.c_sq = (np.ones_like(x) for x in (self.R, self.Q, self.c))
        self.tokens = 0

    def model(self) -> Model:
        return Model(*(x.astype(np.float64) for x in (self.R[:CLASSES], self.Q[:, :WIDTH], *self.c, self.Q[:, WIDTH])))

    def learn(self, w: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> None:
        """A step for every ``BATCH`` tokens."""
        with np.errstate(over="ignore"):
            for a in range(0, len(w), BATCH):
                self._step(w[a:a + BATCH], x1[a:a + BATCH], x2[a:a + BATCH])

    def _step(self, w: np.ndarray, x1: np.ndarray, x2: np.ndarray, inner: tuple | None = None) -> None:
        r1, r2, h = self._context(x1, x2)
        dh = self._classes(w, h)
        if inner:
            self._inside(h, dh, *inner)
        self._learn_contexts(x1, x2, r1, r2, dh)
        self.tokens += len(w)

    def _context(self, x1: np.ndarray, x2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r1, r2 = self.R.take(x1, axis=0), self.R.take(x2, axis=0)
        return r1, r2, _mixed(r1, r2, *self.c)

    def _classes(self, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The gradient of the contexts; moves the classes' target vectors."""
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), len(self.edges) - 1)
        qw, qn = self.Q.take(w, axis=0), self.Q.take(noise, axis=0)
        up = np.einsum("ij,ij->i", h, qw)
        up -= self.noise[w]
        up = _sigmoid_of_negative(up)[:, None]  # 1 - P(data)
        down = h @ np.negative(qn).T
        down += self.noise[noise]
        down = _sigmoid_of_negative(down)  # P(data) of a noise word
        dh = up * qw
        dh -= down @ qn
        g = _sums(np.concatenate([w, noise]), np.concatenate([up * h, -(down.T @ h)]), len(self.Q))
        _adagrad(self.Q, self.Q_sq, g)
        return dh[:, :WIDTH]

    def _learn_contexts(self, x1: np.ndarray, x2: np.ndarray, r1: np.ndarray, r2: np.ndarray, dh: np.ndarray) -> None:
        at, g, times = _merged(x1, x2, dh * self.c[0], dh * self.c[1])
        self._move_contexts(at, g, times)
        ones = np.ones(len(dh), np.float32)
        _adagrad(self.c, self.c_sq, np.stack([ones @ (dh * r1), ones @ (dh * r2)]))

    def _move_contexts(self, at: np.ndarray, g: np.ndarray, times: np.ndarray) -> None:
        _adagrad(self.R, self.R_sq, _sums(at, g, len(self.R)))


def _with_bias(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([q, b[:, None]], axis=1).astype(np.float32)


def _mixed(r1: np.ndarray, r2: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """The weighted context of every token, and a column of ones for the biases."""
    h = np.ones((len(r1), WIDTH + 1), np.float32)
    h[:, :WIDTH] = r1 * c1
    h[:, :WIDTH] += r2 * c2
    return h


def _adagrad(x: np.ndarray, sq: np.ndarray, g: np.ndarray) -> None:
    sq += g * g
    g = g * np.float32(LEARNING_RATE)
    g /= np.sqrt(sq)
    x += g


def _sigmoid_of_negative(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)); takes ``x`` for itself.  Where exp overflows, it is 0."""
    np.exp(x, out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


def _merged(x1: np.ndarray, x2: np.ndarray, g1: np.ndarray, g2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, gradient, how many) of contexts at both positions.  The word before the last of
    a token mostly is the last word of the token before, so one row has the gradients of both."""
    apart = np.flatnonzero(x2[1:] != x1[:-1]) + 1
    apart = np.concatenate([[0], apart])
    alone = g2.take(apart, axis=0)
    g2[apart] = 0
    g1[:-1] += g2[1:]
    times = np.full(len(x1) + len(apart), 2)
    times[apart - 1] = 1  # the last row has none after it
    times[len(x1) - 1:] = 1
    return np.concatenate([x1, x2[apart]]), np.concatenate([g1, alone]), times


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    width = rows.shape[1]
    flat = (at[:, None] * width + np.arange(width)).ravel()
    return np.bincount(flat, rows.ravel(), n * width).reshape(n, width).astype(np.float32)


def _sorted(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers ascending, where each is in ``at``, whether it is the first of its kind)."""
    bits = len(at).bit_length()
    key = at.astype(np.int64) << bits | np.arange(len(at))
    key.sort()
    order, key = key & ((1 << bits) - 1), key >> bits
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return key, order, new


def _sparse_sums(at: np.ndarray, rows: np.ndarray, times: np.ndarray | None = None
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, where it is first, sum of its rows, how many) of every number in ``at``, ascending;
    a row counts once or ``times``."""
    key, order, new = _sorted(at)
    first = new.nonzero()[0]
    n = np.empty(len(first), np.int64)
    np.subtract(first[1:], first[:-1], out=n[:-1])
    n[-1:] = len(key) - first[-1:]
    where = order[first]
    out = rows.take(where, axis=0)
    many = (n > 1).nonzero()[0]
    if len(many):
        # the second rows of all numbers are added together, then the third and so on
        few = np.minimum(n[many], FEW + 1).astype(np.uint8)
        many = many[np.argsort(few, kind="stable")[::-1]]
        more = (len(many) - np.bincount(few, minlength=FEW + 1).cumsum()).tolist()  # numbers with more rows than that
        sums, begin = out.take(many, axis=0), first[many]
        i = 1
        while i < FEW and more[i] > 16:
            k = more[i]
            sums[:k] += rows.take(order[begin[:k] + i], axis=0)
            i += 1
        if k := more[i]:
            rest = n[many[:k]] - i
            cut = rest.cumsum() - rest
            places = np.repeat(begin[:k] + i - cut, rest) + np.arange(rest.sum())
            sums[:k] += np.add.reduceat(rows.take(order[places], axis=0), cut, axis=0)
        _put(out, many, sums)
    return key[first], where, out, n if times is None else np.add.reduceat(times[order], first)


def _put(x: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """x[at] = rows, a row at a time instead of a number."""
    row = np.dtype((np.void, x.itemsize * x.shape[1]))
    x.view(row).reshape(-1)[at] = rows.view(row).reshape(-1)


class WordTrainer(Trainer):
    """The last round: learned words as contexts, and the softmaxes inside classes and cells,
    by noise-contrastive estimation with uniform noise from the same class or cell."""

    def __init__(self, model: Model, share: np.ndarray, tree: Tree, nodes: np.ndarray, seed: int):
        super().__init__(model, share, seed)
        self.tree = tree
        cells = tree.cells[-1]
        self.R = np.concatenate([self.R, nodes[cells:, :WIDTH]])
        self.R_sq = np.concatenate([self.R_sq, np.full((len(nodes) - cells, WIDTH), 0.1, np.float32)])
        self.targets = np.ascontiguousarray(nodes[:, WIDTH:])
        self.target_sq = np.full(self.targets.shape, 0.1, np.float32)
        self.met = np.zeros(len(nodes), np.int64)

    def nodes(self, at: np.ndarray) -> np.ndarray:
        """Context vector, target vector and bias of some cells (no context vector) and words."""
        cells = self.tree.cells[-1]
        out = np.zeros((len(at), 2 * WIDTH + 1), np.float32)
        words = at >= cells
        out[words, :WIDTH] = self.R[CLASSES + at[words] - cells]
        out[:, WIDTH:] = self.targets[at]
        return out

    def learn(self, w: np.ndarray, x: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> None:
        cuts, *inner = self._inner(w, x)
        with np.errstate(over="ignore"):
            for i, a in enumerate(range(0, len(w), BATCH)):
                low, middle, high = cuts[2 * i:2 * i + 3]
                self._step(w[a:a + BATCH], x1[a:a + BATCH], x2[a:a + BATCH],
                           (middle - low, *(column[low:high] for column in inner)))

    def _inner(self, w: np.ndarray, x: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The softmaxes inside classes, then those inside cells, batch by batch: where each
        batch's begin, then token, target node, first node, size of the group and its noise.  Nodes that are
        alone in their group have probability 1 and nothing to learn."""
        t, cells = self.tree, self.tree.cells[-1]
        shaped, learned, cell, number = t.places(w, x)
        shape, inside = w[shaped] - OWN, t.cell[number]
        low = np.concatenate([t.cells[shape], cells + t.words[inside]])
        size = np.concatenate([t.cells[shape + 1], cells + t.words[inside + 1]]) - low
        token, target = np.concatenate([shaped, learned]), np.concatenate([cell, cells + number])
        turn = 2 * (token // BATCH)
        turn[len(shaped):] += 1
        some = np.flatnonzero(size > 1)
        some = some[np.argsort(turn[some], kind="stable")]
        cuts = np.searchsorted(turn[some], np.arange(2 * (-(-len(w) // BATCH)) + 1))
        size = size[some]
        return cuts.tolist(), token[some] % BATCH, target[some], low[some], size, np.log(NOISE_IN / size).astype(np.float32)

    def _move_contexts(self, at: np.ndarray, g: np.ndarray, times: np.ndarray) -> None:
        at, _, g, n = _sparse_sums(at, g, times)
        self._move(self.R, self.R_sq, at, self.R.take(at, axis=0), g)
        words = np.searchsorted(at, CLASSES)
        self.met[at[words:] - CLASSES + self.tree.cells[-1]] += n[words:]

    @staticmethod
    def _move(x: np.ndarray, sq: np.ndarray, at: np.ndarray, now: np.ndarray, g: np.ndarray) -> None:
        """A step of the rows ``at`` of x, which are ``now``."""
        s = sq.take(at, axis=0)
        s += g * g
        _put(sq, at, s)
        g *= np.float32(LEARNING_RATE)
        np.sqrt(s, out=s)
        g /= s
        g += now
        _put(x, at, g)

    def _inside(self, h: np.ndarray, dh: np.ndarray, classes: int, rows: np.ndarray, target: np.ndarray,
                low: np.ndarray, size: np.ndarray, noise: np.ndarray) -> None:
        """Moves the target vectors of cells and words; ``dh`` grows in place.  The first
        ``classes`` rows are inside classes, the others inside cells."""
        if not len(rows):
            return
        every = np.empty((len(rows), 1 + NOISE_IN), np.int64)
        every[:, 0] = target
        every[:, 1:] = self.rng.random((len(rows), NOISE_IN)) * size[:, None]
        every[:, 1:] += low[:, None]
        every = every.ravel()
        hr = h.take(rows, axis=0)
        now = self.targets.take(every, axis=0)
        q = now.reshape(len(rows), 1 + NOISE_IN, WIDTH + 1)
        g = np.einsum("ij,ikj->ik", hr, q)
        g -= noise[:, None]
        np.negative(g, out=g)
        np.negative(_sigmoid_of_negative(g), out=g)
        g[:, 0] += 1
        back = np.einsum("ik,ikj->ij", g, q)[:, :WIDTH]
        dh[rows[:classes]] += back[:classes]
        dh[rows[classes:]] += back[classes:]
        at, where, sums, times = _sparse_sums(every, np.einsum("ik,ij->ikj", g, hr).reshape(-1, WIDTH + 1))
        self._move(self.targets, self.target_sq, at, now.take(where, axis=0), sums)
        self.met[at] += times


class Lookup:
    """Finds hashes among sorted ones: their leading bits say where to begin."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.append(hashes, np.uint64(0))  # the end is never a hit beyond the last
        self.n = len(hashes)
        bits = max(1, (4 * self.n).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of every hash."""
        spot = self.begin[h >> self.shift].astype(np.int64)
        at = np.flatnonzero((self.hashes[spot] < h) & (spot < self.n))
        while len(at):
            spot[at] += 1
            at = at[(self.hashes[spot[at]] < h[at]) & (spot[at] < self.n)]
        return spot, (self.hashes[spot] == h) & (spot < self.n)


def sequences(words: Words, h: np.ndarray, lookup: Lookup, classes: np.ndarray, learned: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, word, word before, word before that, text) of every token, ends included.  A
    word is its class or, if it is learned, ``CLASSES`` and its number."""
    return placed(words, *lookup.find(h), classes, learned)


def placed(words: Words, spot: np.ndarray, hit: np.ndarray, classes: np.ndarray, learned: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``sequences`` of words whose places among the hashes are known."""
    n = len(words.first) - 1
    cls = shape_class(words)
    word = cls
    if len(classes):
        spot = np.where(hit, spot, 0)
        own, number = classes[spot], learned[spot]
        cls = np.where(hit & (own >= 0), own, cls)
        word = np.where(hit & (number >= 0), CLASSES + number, cls)
    ends = words.first[1:] + np.arange(n)  # where the ends go among all tokens
    w, x = np.full(len(cls) + n, END), np.full(len(cls) + n, END)
    word_at = np.arange(len(cls)) + words.doc
    w[word_at], x[word_at] = cls, word
    doc = np.empty(len(w), np.int64)
    doc[word_at], doc[ends] = words.doc, np.arange(n)
    x1, x2 = np.full(len(w), END), np.full(len(w), END)
    same1 = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    x1[same1] = x[same1 - 1]
    same2 = np.flatnonzero(doc[2:] == doc[:-2]) + 2
    x2[same2] = x[same2 - 2]
    return w, x, x1, x2, doc


def train(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> tuple[Model, np.ndarray]:
    """``rounds`` passes over all training texts: the classes' model, and the vectors and
    biases of cells and learned words."""
    spark = texts.sparkSession
    own = vocab.classes >= 0
    mass = np.ones(CLASSES)
    mass[vocab.classes[own]] += vocab.counts[own]
    mass[OWN:END] += vocab.sums
    mass[END] += vocab.ends
    share = mass / mass.sum()
    model = Model.start(share)
    size = len(model.flat())
    cuts = np.linspace(0, size, BLOCKS + 1).astype(int)
    nodes = vocab.tree.start(model)
    for turn in range(rounds):
        last = turn == rounds - 1
        nodes = vocab.tree.start(model) if last else nodes
        shared = spark.sparkContext.broadcast(
            (model, share, *vocab.only(own | (vocab.learned >= 0) if last else own), *((vocab.tree, nodes) if last else (None, None))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, share, hashes, classes, learned, tree, nodes = shared.value
            lookup = Lookup(hashes)
            seed = 1000 * turn + TaskContext.get().partitionId()
            trainer = Trainer(model, share, seed) if tree is None else WordTrainer(model, share, tree, nodes, seed)
            held: list[np.ndarray] = []
            size = 0
            for b in batches:
                for _, _, buf, offs in text_chunks(b.column("text"), 1 << 18):
                    words = Words(LOWER[buf], offs)
                    w, x, x1, x2, _ = sequences(words, words.hashes(), lookup, classes, learned)
                    held.append(np.stack([w, x1, x2] if tree is None else [w, x, x1, x2]))
                    size += len(w)
                    if size >= BATCH:
                        every = np.concatenate(held, axis=1)
                        rest = size % BATCH
                        trainer.learn(*every[:, :size - rest])
                        held, size = [every[:, size - rest:]], rest
            if size:
                trainer.learn(*np.concatenate(held, axis=1))
            if trainer.tokens:
                flat = trainer.model().flat()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(np.full(BLOCKS, trainer.tokens)),
                    pa.array([[]] * BLOCKS, pa.list_(pa.int32())), pa.array([[]] * BLOCKS, pa.list_(pa.int64())),
                    pa.array([flat[a:z].tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary())], names=names)
            if tree is not None:
                met = np.flatnonzero(trainer.met)
                for group in np.split(met, np.flatnonzero(np.diff(met // NODES)) + 1) if len(met) else []:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([BLOCKS + group[0] // NODES], pa.int32()), pa.array([trainer.tokens]),
                        pa.array([group], pa.list_(pa.int32())), pa.array([trainer.met[group]], pa.list_(pa.int64())),
                        pa.array([trainer.nodes(group).tobytes()], pa.binary())], names=names)

        def average(table: pa.Table) -> pa.Table:
            block = table.column("block")[0].as_py()
            n = table.column("tokens").to_numpy().astype(np.float64)
            parts = table.column("part").to_pylist()
            # sums do not depend on the order of arrival
            order = sorted(range(len(parts)), key=lambda i: (n[i], parts[i]))
            if block < BLOCKS:
                at, mean = [], sum(n[i] * np.frombuffer(parts[i]) for i in order) / n.sum()
            else:
                ats, mets = table.column("at").to_pylist(), table.column("met").to_pylist()
                total, weight = np.zeros((NODES, 2 * WIDTH + 1)), np.zeros(NODES)
                for i in order:
                    a, m = np.array(ats[i]) % NODES, np.array(mets[i], np.float64)
                    total[a] += m[:, None] * np.frombuffer(parts[i], np.float32).reshape(len(a), -1)
                    weight[a] += m
                at = np.flatnonzero(weight)
                mean = (total[at] / weight[at, None]).astype(np.float32)
                at = ((block - BLOCKS) * NODES + at).tolist()
            return pa.table({"block": pa.array([block], pa.int32()), "at": pa.array([at], pa.list_(pa.int32())),
                             "part": pa.array([mean.tobytes()], pa.binary())})

        names = ["block", "tokens", "at", "met", "part"]
        models = texts.select("text").mapInArrow(run, "block int, tokens long, at array<int>, met array<long>, part binary")
        rows = publish(models.groupBy("block").applyInArrow(average, "block int, at array<int>, part binary"),
                       "lbl-models").orderBy("block").collect()
        if rows:
            model = Model.of(np.concatenate([np.frombuffer(r["part"]) for r in rows if r["block"] < BLOCKS]), CLASSES)
        for r in rows:
            if r["block"] >= BLOCKS:
                nodes[r["at"]] = np.frombuffer(r["part"], np.float32).reshape(len(r["at"]), -1)
    return model, nodes


class Scorer:
    """Normalised log10 probabilities: of classes over all classes, and inside a class over
    its cells and inside a cell over its words."""

    def __init__(self, model: Model, tree: Tree | None = None, nodes: np.ndarray | None = None):
        cells = tree.cells[-1] if tree else 0
        nodes = np.empty((0, 2 * WIDTH + 1), np.float32) if nodes is None else nodes
        self.R = np.concatenate([model.R.astype(np.float32), nodes[cells:, :WIDTH]])
        self.Q = _with_bias(model.Q, model.b)
        self.c = np.stack([model.c1, model.c2]).astype(np.float32)
        self.tree, self.targets = tree, np.ascontiguousarray(nodes[:, WIDTH:])
        # contexts of two classes are few: their sums are computed once
        self.pairs = np.stack([self._log_totals(_mixed(np.repeat(self.R[i:i + 1], CLASSES, axis=0), self.R[:CLASSES], *self.c))
                               for i in range(CLASSES)])

    def log10(self, w: np.ndarray, x1: np.ndarray, x2: np.ndarray, x: np.ndarray | None = None,
              totals: np.ndarray | None = None) -> np.ndarray:
        """Of the class; with ``x`` also of the cell and the word in it (rare words: of the
        cell only).  ``totals`` are those of ``context_totals``, if known."""
        h = _mixed(self.R.take(x1, axis=0), self.R.take(x2, axis=0), *self.c)
        out = np.einsum("ij,ij->i", h, self.Q.take(w, axis=0)).astype(np.float64)
        out -= self.context_totals(x1, x2) if totals is None else totals
        if x is not None:
            t = self.tree
            shaped, learned, cell, number = t.places(w, x)
            self._inside(out, h, shaped, w[shaped] - OWN, cell, t.cells, 0)
            self._inside(out, h, learned, t.cell[number], number, t.words, t.cells[-1])
        return out / np.log(10)

    def context_totals(self, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
        """The logarithm of each context's sum of exp of scores over all classes.  A score is a
        sum of what the two words add, so the sum is the product of one row of exp per word and
        position: each is computed once for all contexts at hand (``WIDE`` second words, the
        frequent ones first, against ``NARROW`` first words at a time)."""
        classes = (x1 < CLASSES) & (x2 < CLASSES)
        out = np.empty(len(x1))
        out[classes] = self.pairs[x1[classes], x2[classes]]
        words = np.flatnonzero(~classes)
        if not len(words):
            return out
        key, order, new = _sorted(x2[words])
        first = np.flatnonzero(new)
        by_times = np.argsort(-np.diff(np.append(first, len(key))), kind="stable")
        rank = np.empty(len(first), np.int64)
        rank[by_times] = np.arange(len(first))
        seconds = key[first[by_times]]
        second = np.empty(len(words), np.int64)
        second[order] = rank[np.cumsum(new) - 1]
        table1, table2 = (np.empty((min(n, len(words)), len(self.Q)), np.float32) for n in (NARROW, WIDE))
        block1, block2 = np.empty((2, 128, len(self.Q)), np.float32)
        for a in range(0, len(seconds), WIDE):
            here = np.flatnonzero((second >= a) & (second < a + WIDE))
            e2, top2 = self._factors(seconds[a:a + WIDE], 1, table2)
            key, order, new = _sorted(x1[words[here]])
            firsts, first = key[new], np.empty(len(here), np.int64)
            first[order] = np.cumsum(new) - 1
            # block of first words by block, and second words together in each
            order = _sorted(first // NARROW * WIDE + second[here] - a)[1]
            here, first = here[order], first[order]
            cuts = np.searchsorted(first // NARROW, np.arange(-(-len(firsts) // NARROW) + 1)).tolist()
            for b, low, high in zip(range(0, len(firsts), NARROW), cuts, cuts[1:]):
                e1, top1 = self._factors(firsts[b:b + NARROW], 0, table1)
                tokens, i1, i2 = words[here[low:high]], first[low:high] - b, second[here[low:high]] - a
                sums = np.empty(high - low, np.float32)
                for c in range(0, high - low, 128):
                    n = min(128, high - low - c)
                    np.einsum("ij,ij->i", e1.take(i1[c:c + n], axis=0, out=block1[:n], mode="clip"),
                              e2.take(i2[c:c + n], axis=0, out=block2[:n], mode="clip"), out=sums[c:c + n])
                tiny = np.flatnonzero(sums < 1e-25)  # the words' best classes lie far apart
                sums[tiny] = 1
                out[tokens] = np.log(sums.astype(np.float64)) + top1[i1] + top2[i2]
                if len(tiny):
                    t = tokens[tiny]
                    out[t] = self._log_totals(_mixed(self.R.take(x1[t], axis=0), self.R.take(x2[t], axis=0), *self.c))
        return out

    def _factors(self, x: np.ndarray, position: int, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per word the exp of what it adds to the score of each class (with the bias at the
        second position), over their greatest, and the logarithm of that; written to ``out``."""
        r = np.full((len(x), WIDTH + 1), float(position), np.float32)
        np.multiply(self.R.take(x, axis=0), self.c[position], out=r[:, :WIDTH])
        out, top = out[:len(x)], np.empty(len(x), np.float32)
        for a in range(0, len(x), 256):
            s = np.matmul(r[a:a + 256], self.Q.T, out=out[a:a + 256])
            s.max(axis=1, out=top[a:a + 256])
            s -= top[a:a + 256, None]
            np.exp(s, out=s)
        return out, top

    def _log_totals(self, h: np.ndarray) -> np.ndarray:
        """The logarithm of each context's sum of exp of scores over all classes."""
        out = np.empty(len(h))
        ones = np.ones(len(self.Q), np.float32)
        block = np.empty((128, len(self.Q)), np.float32)  # stays in the cache
        for a in range(0, len(h), 128):
            part = h[a:a + 128]
            s = np.matmul(part, self.Q.T, out=block[:len(part)])
            top = s.max(axis=1)
            s -= top[:, None]
            out[a:a + 128] = np.log(np.exp(s, out=s) @ ones) + top
        return out

    def _inside(self, out: np.ndarray, h: np.ndarray, rows: np.ndarray, group: np.ndarray, target: np.ndarray,
                first: np.ndarray, offset: int) -> None:
        """Sorted by group, the tokens of a block write their products side by side, for one
        softmax over all of them; groups of more than ``CELL`` nodes have blocks of their own."""
        size = first[group + 1] - first[group]
        for small in (True, False):
            some = np.flatnonzero((size > 1) & ((size <= CELL) == small))
            own = some[np.argsort(group[some], kind="stable")]
            low, at, n = first[group[own]], target[own] - first[group[own]], size[own]
            new = np.ones(len(own), bool)
            new[1:] = low[1:] != low[:-1]
            new[::2048 if small else 256] = True
            cut = np.flatnonzero(new)
            cuts = list(zip(cut.tolist(), np.append(cut[1:], len(own)).tolist(), low[cut].tolist(), n[cut].tolist()))
            own = rows[own]
            hs = h.take(own, axis=0)
            if not small:
                for a, z, lo, k in cuts:
                    out[own[a:z]] += _log_share(hs[a:z] @ self.targets[offset + lo:offset + lo + k].T, at[a:z])
                continue
            block = np.empty((2048, CELL), np.float32)
            for a, z, lo, k in cuts:
                b = a % 2048
                if b == 0:
                    block.fill(-1e30)
                np.matmul(hs[a:z], self.targets[offset + lo:offset + lo + k].T, out=block[b:b + z - a, :k])
                if z % 2048 == 0 or z == len(own):
                    out[own[a - b:z]] += _log_share(block[:b + z - a], at[a - b:z])


def _log_share(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural logarithm of the softmax of each row at ``at``; takes ``s`` for itself."""
    own = s[np.arange(len(s)), at].astype(np.float64)
    if s.max() > 60 or own.min() < -60:  # exp would leave the range of numbers
        top = s.max(axis=1, keepdims=True)
        own -= top[:, 0]
        s -= top
    return own - np.log(np.exp(s, out=s) @ np.ones(s.shape[1], np.float32))


# ---- scores --------------------------------------------------------------------------------

def score(docs: DataFrame, folds: int = FOLDS, rest: int = 2, rounds: int = ROUNDS,
          frequent: int = FREQUENT, learned: int = LEARNED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10
    probability under the model) of every whole text.

    A null text is an empty one: its only token is the end.  Repeated rows stay; rows with a
    null id neither train nor count as held out; without training texts nothing is known and
    the model stays at its start; extra columns are ignored."""
    spark = docs.sparkSession
    texts = docs.filter(fold(F.col("doc_id"), folds) != rest).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = publish(count_words(texts), "word-counts")
    vocab = vocabulary(counts, texts.count(), frequent, learned)
    model, nodes = train(texts, vocab, rounds)
    shared = spark.sparkContext.broadcast((vocab, Scorer(model, vocab.tree, nodes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, scorer = shared.value
        lookup = Lookup(vocab.hashes)
        log_count = np.log10(vocab.counts + 1.0)
        log_sum = np.log10(vocab.tree.rare)
        row = TaskContext.get().partitionId() << 36

        def prepared(column: pa.Array) -> Iterator[Chunk]:
            for _, _, buf, offs in text_chunks(column):
                words = Words(LOWER[buf], offs)
                h = words.hashes()
                spot, hit = lookup.find(h)
                spot = np.where(hit, spot, 0)
                *x, doc = placed(words, spot, hit, vocab.classes, vocab.learned)
                yield Chunk(words.counts(), spot.astype(np.int32), hit, h[~hit], (shape_class(words) - OWN).astype(np.int8),
                            np.stack(x).astype(np.int32), doc.astype(np.int32))

        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for chunks in _together(prepared(b.column("text"))):
                totals = scorer.context_totals(*(np.concatenate([c.x[i] for c in chunks]) for i in (2, 3)))
                for c, total in zip(chunks, np.split(totals, np.cumsum([len(c.doc) for c in chunks])[:-1])):
                    n = len(c.counts)
                    words_doc = np.repeat(np.arange(n), c.counts)
                    w, x, x1, x2 = c.x.astype(np.int64)
                    model10 = np.bincount(c.doc, scorer.log10(w, x1, x2, x, total), n)
                    seen = np.where(c.hit, log_count[c.spot] if len(log_count) else 0.0, 0.0)
                    shared_cell = ~c.hit
                    if len(vocab.classes):
                        shared_cell |= (vocab.classes[c.spot] < 0) & (vocab.learned[c.spot] < 0)
                    model10 += np.bincount(words_doc, np.where(shared_cell, seen - log_sum[c.shape], 0.0), n)
                    base10 = np.bincount(words_doc, seen, n) + np.log10(vocab.ends + 1.0)
                    known = np.bincount(words_doc, c.hit, n).astype(np.int64) + (vocab.ends > 0)
                    rare, first, times = _rare(words_doc[~c.hit], c.missed)
                    cut = np.searchsorted(rare, np.arange(n + 1))
                    cols[0] += (c.counts + 1).tolist()
                    cols[1] += known.tolist()
                    cols[2] += base10.tolist()
                    cols[3] += model10.tolist()
                    cols[4] += [first[a:z] for a, z in zip(cut, cut[1:])]
                    cols[5] += [times[a:z] for a, z in zip(cut, cut[1:])]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.arange(n)), b.column("doc_id"), b.column("held_out"), pa.array(cols[0], pa.int64()),
                pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()),
                pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.list_(pa.int32()))],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base10", "model10", "rare", "times"])
            row += n

    rows = docs.select("doc_id", held_out(F.col("doc_id"), folds, rest).alias("held_out"), "text")
    scored = publish(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base10 double, "
                                          "model10 double, rare array<bigint>, times array<int>"), "lbl-scores")
    others = (scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t"))
              .select("row", F.col("t.rare").alias("h"), F.col("t.times").alias("n"))
              .join(counts.filter(F.col("c") < vocab.floor).select("h", "c"), "h")
              .groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more10"), F.sum("n").alias("more")))
    more10, more = F.coalesce("more10", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return (scored.drop("rare", "times").join(others, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("known") + more).alias("n_known"),
                    F.lit(vocab.tokens).cast("long").alias("train_tokens"),
                    (F.col("base10") + more10 - F.col("n_tokens") * F.lit(float(np.log10(vocab.tokens + vocab.types + 1.0))))
                    .alias("base_score"),
                    (F.col("model10") + more10).alias("score")))


@dataclass
class Chunk:
    """What scoring keeps of some texts: words per text, then per word its place among the
    frequent words, whether it is there and its shape class (hashes of those that are not), then
    per token, ends included, class, word and the two words before (a row each), and text."""

    counts: np.ndarray
    spot: np.ndarray
    hit: np.ndarray
    missed: np.ndarray
    shape: np.ndarray
    x: np.ndarray
    doc: np.ndarray


def _together(chunks: Iterator[Chunk], tokens: int = TOGETHER) -> Iterator[list[Chunk]]:
    """Runs of chunks of about ``tokens`` tokens together, whose contexts share words."""
    held: list[Chunk] = []
    for c in chunks:
        held.append(c)
        if sum(len(c.doc) for c in held) >= tokens:
            yield held
            held = []
    if held:
        yield held


def _rare(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, times) of each distinct word per text, by text."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at].view(np.int64), np.diff(np.append(at, len(h))).astype(np.int32)
