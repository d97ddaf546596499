"""Scores of a log-bilinear language model over words in two levels, trained by noise-contrastive estimation."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import col, give_back, query, table, written

#: The token after the last word of a text: a blank, which no word holds.
END = b"\n"
#: Upper level of the model: classes of one frequent word each, and classes of all other words by their endings.
#: The words of the latter have vectors of their own, as contexts and as targets inside their class.
HEADS, TAILS = 63, 32
CLASSES = 1 + HEADS + TAILS
#: Tokens of one chunk of texts, which has its own word numbers.
CHUNK_TOKENS = 4_000_000
#: Numbers of a vector, and training steps of the upper level, each over the counts of the whole training corpus.
WIDTH, STEPS = 24, 1_000
#: States of the context that the words of a class are told apart by, and steps of their vectors.
STATES, WORD_STEPS = 64, 24
SETTLED = 1e-3
#: Noise words for every word of the corpus.
NOISE = 12
#: Weights of the normal priors that hold a word's vectors to its class: of its context and of its target vector.
CONTEXT_PRIOR, TARGET_PRIOR = 200.0, 15.0
#: Rows (chunk, word) that are trained together, and tokens that are scored together.
BUCKET_ROWS, SCORED = 200_000, 4_096
#: Occurrences of a bucket's words that are held at once.
MET_AT_ONCE = 4_000_000


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII blanks with A-Z lower-cased, then the end."""
    return [*(text or b"").lower().split(), END]


def tail_class(word: bytes) -> int:
    """The upper class of a word that is not frequent, by its last two bytes."""
    return 1 + HEADS + zlib.crc32(word[-2:]) % TAILS


def held_out(id: Column) -> Column:
    """Rows that teach nothing: crc32 of the id as text leaves 2 when divided by 7."""
    return F.crc32(F.encode(F.coalesce(id.cast("string"), F.lit("")), "UTF-8")) % 7 == 2


def _chunks(batches: Iterator[pa.RecordBatch], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per chunk: its distinct words with their counts in training, and each text as word numbers."""
    part, made = TaskContext.get().partitionId(), 0
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    ids, held, texts, size = [], [], [], 0

    def close() -> pa.RecordBatch:
        nonlocal made, numbers, ids, held, texts, size
        flat = np.concatenate(texts)
        taught = np.concatenate([t for t, h in zip(texts, held) if not h] or [flat[:0]])
        row = [
            (part << 32) + made, list(numbers), np.bincount(taught, minlength=len(numbers)).tolist(), ids, held,
            [len(t) for t in texts], zlib.compress(flat.tobytes(), 1),
        ]
        made += 1
        numbers.default_factory = None  # which held the dictionary itself
        numbers = defaultdict()
        numbers.default_factory = numbers.__len__
        ids, held, texts, size = [], [], [], 0
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, shape)], schema=shape)

    for batch in batches:
        for id, out, text in zip(batch["id"].to_pylist(), batch["held_out"].to_pylist(), batch["text"].cast(pa.binary())):
            found = tokens(text.as_py())
            texts.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
            ids.append(id)
            held.append(out)
            size += len(found)
            if size >= CHUNK_TOKENS:
                yield close()
    if texts:
        yield close()


def chunked(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as a written table of chunks; it is read instead of the texts from here on."""
    rows = docs.select(col(id).alias("id"), held_out(col(id)).alias("held_out"), col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"chunk long, words array<binary>, taught array<long>, ids array<{kind}>, held array<boolean>, sizes array<int>, text binary"
    shape = None

    def cut(batches):
        nonlocal shape
        first = next(batches, None)
        if first is None:
            return
        shape = pa.schema([
            ("chunk", pa.int64()), ("words", pa.list_(pa.binary())), ("taught", pa.list_(pa.int64())), ("ids", pa.list_(first["id"].type)),
            ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("text", pa.binary()),
        ])
        yield from _chunks((b for bs in ([first], batches) for b in bs), shape)

    return written(rows.mapInArrow(cut, schema))


def _numbers(flat: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(flat), np.uint32)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _before(classes: np.ndarray, starts: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The classes (or word numbers) of the last and the last but one token; before a text stand ends (class 0)."""
    one = np.r_[end, classes[:-1]].astype(classes.dtype) if len(classes) else classes
    one[starts] = end
    two = np.r_[end, one[:-1]].astype(classes.dtype) if len(one) else one
    two[starts] = end
    return one, two


def class_of(words: list[bytes] | pa.Array, heads: dict[bytes, int]) -> np.ndarray:
    """The upper class of every word; endings are told apart by array operations."""
    words = words.cast(pa.binary()) if isinstance(words, pa.Array) else pa.array(words, pa.binary())
    named = pc.index_in(words, pa.array([END, *heads], pa.binary())).fill_null(-1).to_numpy()
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    letters = np.r_[np.zeros(2, np.uint8), np.frombuffer(words.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]]
    long, ends = np.diff(bounds), bounds[1:] - bounds[0]
    # An ending of two bytes as a number, of one byte beyond those, of none beyond these.
    ending = np.where(long > 1, letters[ends].astype(np.int64) << 8, 1 << 16) | letters[ends + 1]
    ending[long == 0] = 1 << 17
    kinds, of = np.unique(ending, return_inverse=True)
    tails = [tail_class(b"" if e >> 17 else bytes([e & 255]) if e >> 16 else bytes([e >> 8, e & 255])) for e in kinds.tolist()]
    return np.where(named >= 0, np.array([0, *heads.values()], np.int64)[named], np.array(tails, np.int64)[of] if tails else 0)


@dataclass
class LogBilinear:
    """p = C1 q(last) + C2 q(last but one); the score of class w is p.r(w) + b(w)."""

    targets: np.ndarray
    contexts: np.ndarray
    first: np.ndarray
    second: np.ndarray
    bias: np.ndarray

    @classmethod
    def train(cls, grams: np.ndarray, counts: np.ndarray, width: int = WIDTH, noise: int = NOISE, steps: int | None = None, seed: int = 7) -> LogBilinear:
        """Noise-contrastive estimation by Adagrad steps, each over all class trigrams with their corpus counts.

        ``grams``: (last but one, last, next) rows. The classes are few, so nothing is drawn: a step
        tells every counted trigram from ``noise`` next classes per context in expectation over the
        unigram distribution, which is also where the biases start; without counts the model stays
        uniform. ``seed`` gives the start of the vectors.
        """
        rng = np.random.default_rng(seed)
        m = [rng.normal(0, 0.1, (CLASSES, width)), rng.normal(0, 0.1, (CLASSES, width)), np.eye(width) * 0.5, np.eye(width) * 0.25, np.zeros(CLASSES)]
        if len(counts):
            unigram = np.bincount(grams[:, 2], counts, CLASSES) + 0.5
            unigram /= unigram.sum()
            m[4] = np.log(unigram)
            floor = np.log(noise * unigram)
            # A row per context with the shares of the corpus of its trigrams; a whole corpus has at most CLASSES ** 2.
            pasts, row = np.unique(grams[:, 0] * CLASSES + grams[:, 1], return_inverse=True)
            a, b = pasts // CLASSES, pasts % CLASSES
            seen = np.bincount(row * CLASSES + grams[:, 2], counts / counts.sum(), len(pasts) * CLASSES).reshape(-1, CLASSES)
            every = seen + seen.sum(axis=1, keepdims=True) * (noise * unigram)
            one, two = (np.zeros((CLASSES, len(pasts))) for _ in range(2))
            one[b, np.arange(len(pasts))] = two[a, np.arange(len(pasts))] = 1
            past = [np.full(x.shape, 1e-3) for x in m]
            for _ in range(STEPS if steps is None else steps):
                q1, q2 = m[1][b], m[1][a]
                p = q1 @ m[2].T + q2 @ m[3].T
                gap = p @ m[0].T + (m[4] - floor)
                pushed = seen - every / (1 + np.exp(-np.clip(gap, -30, 30)))  # the true class is pushed up by what its probability lacks
                gp = pushed @ m[0]
                grads = [pushed.T @ p, one @ (gp @ m[2]) + two @ (gp @ m[3]), gp.T @ q1, gp.T @ q2, pushed.sum(axis=0)]
                for x, d, h in zip(m, grads, past):
                    h += d * d
                    x += 0.15 * d / np.sqrt(h)
        return cls(*m)

    def table(self) -> np.ndarray:
        """log10 probabilities of the next class, normalised, by (last but one, last): one batched product over all contexts."""
        p = (self.contexts @ self.second.T)[:, None, :] + (self.contexts @ self.first.T)[None, :, :]
        s = p @ self.targets.T + self.bias
        s -= s.max(axis=2, keepdims=True)
        return (s - np.log(np.exp(s).sum(axis=2, keepdims=True))) / math.log(10)


@dataclass
class WordNet:
    """What a word's own vectors are trained with: the net of the classes and everything it says of any two classes before.

    ``left[a, b, y]`` is what the probability of class y after classes a, b lacks to be told from
    noise for sure, ``first`` and ``second`` (a, b) the expected push of the noise on the vector of
    b and of a, ``spread`` the eigenvalues and ``axes`` the eigenvectors of the Fisher information
    of an occurrence of a class's word as a context. ``states`` are the code vectors of context
    states, ``state_net`` and ``state_bias`` give the log weights of the states of a context
    vector, ``state_of`` those of two classes, ``state_share`` the states' shares before a class.
    """

    net: LogBilinear
    left: np.ndarray
    first: np.ndarray
    second: np.ndarray
    spread: np.ndarray
    axes: np.ndarray
    states: np.ndarray
    state_net: np.ndarray
    state_bias: np.ndarray
    state_of: np.ndarray
    state_share: np.ndarray

    @classmethod
    def of(cls, net: LogBilinear, grams: np.ndarray, counts: np.ndarray) -> WordNet:
        n = np.zeros((CLASSES, CLASSES, CLASSES))
        n[tuple(grams.T)] = counts
        unigram = n.sum(axis=(0, 1)) + 0.5
        unigram /= unigram.sum()
        r = net.targets
        p = (net.contexts @ net.second.T)[:, None, :] + (net.contexts @ net.first.T)[None, :, :]
        found = 1 / (1 + np.exp(-np.clip(p @ r.T + (net.bias - np.log(NOISE * unigram)), -30, 30)))
        noise = NOISE * unigram * found
        push = noise @ r
        pasts = n.sum(axis=2)
        share = lambda x, axis: x / np.maximum(x.sum(axis=axis, keepdims=True), 1)
        twice = (r[:, :, None] * r[:, None, :]).reshape(CLASSES, -1)
        square = lambda weights: (weights @ twice).reshape(CLASSES, *net.first.shape)
        spread, axes = np.linalg.eigh(
            net.first.T @ square(np.einsum("ab,abj->bj", share(pasts, 0), noise)) @ net.first
            + net.second.T @ square(np.einsum("ab,abj->aj", share(pasts, 1), noise)) @ net.second
        )
        apart = r - unigram @ r
        states, state_net, state_bias = _states(p.reshape(-1, p.shape[2]), pasts.ravel(), (apart.T * unigram) @ apart)
        of = _weights(p.reshape(-1, p.shape[2]) @ state_net + state_bias)
        before = n.reshape(-1, CLASSES).T @ of + of.mean(axis=0)
        small = lambda x: x.astype(np.float32)
        return cls(
            net, small(1 - found), small(push @ net.first), small(push @ net.second), np.maximum(spread, 0), axes, states, small(state_net), small(state_bias),
            small(of), before / before.sum(axis=1, keepdims=True),
        )


def _weights(logs: np.ndarray) -> np.ndarray:
    x = np.exp(logs - logs.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _states(points: np.ndarray, counts: np.ndarray, metric: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whitened code vectors of the context vectors, and the linear function that gives the log weights of the states of any.

    A mixture of normal distributions of one width, found by expectation and maximisation over
    all contexts of two classes with their corpus counts. Contexts are as near by ``metric``
    as the classes they predict are alike.
    """
    w = (counts + 1e-9) / (counts + 1e-9).sum()
    values, axes = np.linalg.eigh(metric)
    turn = axes * np.sqrt(np.maximum(values, 0))
    x = (points - w @ points) @ turn
    # The first codes: heavy contexts far from those chosen before.
    far, codes = np.full(len(x), np.inf), []
    for _ in range(STATES):
        codes.append(x[np.argmax(w * np.minimum(far, 1e6))])
        far = np.minimum(far, ((x - codes[-1]) ** 2).sum(axis=1))
    codes, part, width = np.stack(codes), np.full(STATES, 1 / STATES), 1.0
    for _ in range(40):
        of = _weights((x @ codes.T - (codes**2).sum(axis=1) / 2) / width + np.log(part)) * w[:, None]
        part = of.sum(axis=0) + 1e-9
        codes = of.T @ x / part[:, None]
        part /= part.sum()
        width = max((of * ((x**2).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes**2).sum(axis=1))).sum() / x.shape[1], 0.01)
    net = turn @ codes.T / width
    bias = np.log(part) - (codes**2).sum(axis=1) / 2 / width - w @ points @ net
    codes = codes - part @ codes
    values, axes = np.linalg.eigh((codes.T * part) @ codes)
    return codes @ (axes / np.sqrt(np.maximum(values, max(1e-3 * values[-1], 1e-9)))), net, bias


@dataclass
class Model:
    """The classes, the table of class probabilities, words and tokens of training per class, and what words are trained with."""

    heads: dict[bytes, int]
    table: np.ndarray
    mass: np.ndarray
    total: int
    kinds: int
    tokens: np.ndarray
    words: WordNet

    def word_scores(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of a word's part of its class: its count and one, of the class's tokens, words and one for all unseen words."""
        return np.log10((counts + 1) / self.mass[classes])


def _class_column(word: Column, heads: dict[bytes, int]) -> Column:
    @F.arrow_udf("int")
    def classes(words: pa.Array) -> pa.Array:
        return pa.array(class_of(words, heads).astype(np.int32))

    return classes(word)


def learn(chunks: DataFrame, counts: DataFrame) -> Model:
    """The model of all chunks; ``counts(word, c)`` has the training count of every word.

    What reaches the driver is bounded by the classes: the most frequent words, sums per
    class and counts of class trigrams; they are taken over every training token.
    """
    seen = counts.where("c > 0")
    top = seen.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(HEADS).collect()
    heads = {bytes(r.word): i for i, r in enumerate(top, 1)}
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, a, b in seen.select(_class_column(F.col("word"), heads).alias("k"), "c").groupBy("k").agg(F.sum("c"), F.count("*")).collect():
        n[k], v[k] = a, b

    def trigrams(batches):
        cells = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for words, held, sizes, text in zip(*(batch[c] for c in ("words", "held", "sizes", "text"))):
                size = np.array(sizes.as_py(), np.int64)
                k = class_of(words.values, heads).astype(np.int32)[_numbers(text.as_py())]
                one, two = _before(k, _starts(size))
                taught = np.repeat(~np.array(held.as_py(), bool), size)
                cells += np.bincount(((two * CLASSES + one) * CLASSES + k)[taught], minlength=len(cells))
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_pydict({"cell": at.astype(np.int32), "n": cells[at]})

    cells = chunks.select("words", "held", "sizes", "text").mapInArrow(trigrams, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()
    cell = cells["cell"].to_numpy().astype(np.int64)
    grams = np.stack([cell // CLASSES**2, cell // CLASSES % CLASSES, cell % CLASSES], axis=1)
    net = LogBilinear.train(grams, cells["n"].to_numpy().astype(float))
    return Model(heads, net.table(), n + v + 1, int(n.sum()), int(v.sum()), n.astype(np.int64), WordNet.of(net, grams, cells["n"].to_numpy().astype(float)))


def _met(batches: Iterator[pa.RecordBatch], heads: dict[bytes, int], buckets: int) -> Iterator[pa.RecordBatch]:
    """Per chunk and bucket, its words that are not frequent and, of each in training, the classes around every occurrence.

    An occurrence is four bytes: the classes of the last but one, the last, the next and the
    next but one token (255: past the end of the text).
    """
    for batch in batches:
        for chunk, words, held, sizes, text in zip(*(batch[c] for c in ("chunk", "words", "held", "sizes", "text"))):
            size, flat, names = np.array(sizes.as_py(), np.int64), _numbers(text.as_py()), words.values
            kinds = class_of(names, heads).astype(np.uint32)
            k = kinds[flat]
            one, two = _before(k, _starts(size))
            after = np.r_[k[1:], np.uint32(0)]
            later = np.where(after == 0, np.uint32(255), np.r_[k[2:], np.zeros(2, np.uint32)][: len(k)])
            own = np.flatnonzero(kinds > HEADS)
            bucket = np.fromiter(map(zlib.crc32, names.take(pa.array(own)).to_pylist()), np.int64, len(own)) % buckets
            order = np.argsort(bucket, kind="stable")
            own, bucket = own[order], bucket[order]
            names = names.take(pa.array(own)).cast(pa.binary())
            rank = np.zeros(len(kinds), np.uint64)
            rank[own] = np.arange(len(own))
            taught = np.flatnonzero(np.repeat(~np.array(held.as_py(), bool), size) & (k > HEADS))
            at = rank[flat[taught]]
            around = two << 24 | one << 16 | after << 8 | later
            around = np.sort(at << np.uint64(32) | around[taught]).astype(np.uint32)
            times = np.bincount(at.astype(np.int64), minlength=len(own)).astype(np.int32)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            seen = np.r_[0, np.cumsum(times)][cut]
            for i in np.flatnonzero(np.diff(cut)):
                a, b = cut[i], cut[i + 1]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([i], pa.int32()), "of": pa.array([chunk.as_py()], pa.int64()), "words": pa.ListArray.from_arrays([0, int(b - a)], names[a:b]),
                    "pos": [own[a:b].astype(np.int32).tobytes()], "times": [times[a:b].tobytes()], "around": [zlib.compress(around[seen[i] : seen[i + 1]].tobytes(), 1)],
                })


def _rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as bytes and the scale of each: they travel to every chunk that has the word."""
    scale = np.maximum(np.abs(x).max(axis=1, initial=0) / 126, 1e-4).astype(np.float16)
    return np.rint(x / scale[:, None].astype(np.float32)).astype(np.int8), scale


class Pairs:
    """How often every word had each pair of classes around it; what is kept is bounded by the pairs, not by the occurrences."""

    def __init__(self):
        self.cells, self.times, self.new, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, word: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        self.new.append(word << np.uint64(16) | a << np.uint32(8) | b)
        self.size += len(word)
        if self.size > MET_AT_ONCE:
            self.fold()

    def fold(self) -> None:
        cells, times = np.unique(np.concatenate([self.cells[:0], *self.new]), return_counts=True)
        if len(self.cells):
            cells, at = np.unique(np.concatenate([self.cells, cells]), return_inverse=True)
            times = np.bincount(at, np.concatenate([self.times, times]), len(cells)).astype(np.int64)
        self.cells, self.times, self.new, self.size = cells, times, [], 0

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Words, first and second classes and times of some words' pairs, and where a word begins."""
        self.fold()
        word = (self.cells >> np.uint64(16)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else word
        for a, b in _blocks(starts, len(word)):
            pair = self.cells[a:b].astype(np.int64)
            yield word[a:b], pair >> 8 & 255, pair & 255, self.times[a:b, None].astype(np.float32), starts[(starts >= a) & (starts < b)] - a


def _context_vectors(words: WordNet, kinds: np.ndarray, counts: np.ndarray, as_last: Pairs, as_second: Pairs) -> np.ndarray:
    """Context vectors of words: from the class's, a Newton step of noise-contrastive estimation of the next classes.

    ``as_last`` has the classes before and after every occurrence in training, ``as_second``
    the next two; all of a word's are in the gradient. The noise is taken in expectation over
    all classes, the information per occurrence is the class's.
    """
    net = words.net
    to_first, to_second = (net.targets @ net.first).astype(np.float32), (net.targets @ net.second).astype(np.float32)
    grads, out = np.zeros((len(kinds), net.contexts.shape[1])), net.contexts[kinds]
    for w, one, after, times, own in as_last.blocks():
        k = kinds[w]
        g = words.left[one, k, after][:, None] * to_first.take(after, 0) - words.first[one, k]
        g *= times
        grads[w[own]] += np.add.reduceat(g, own)
    for w, after, later, times, own in as_second.blocks():
        k = kinds[w]
        g = words.left[k, after, later][:, None] * to_second.take(later, 0) - words.second[k, after]
        g *= times
        grads[w[own]] += np.add.reduceat(g, own)
    for k in np.unique(kinds):
        of = kinds == k
        out[of] += (grads[of] @ words.axes[k] / (counts[of, None] * words.spread[k] + CONTEXT_PRIOR)) @ words.axes[k].T
    return out


def _blocks(starts: np.ndarray, end: int, rows: int = 100_000) -> Iterator[tuple[int, int]]:
    """Ranges of some ``rows`` rows that begin where a group begins; a larger group is a range of its own."""
    a = 0
    while a < end:
        i = np.searchsorted(starts, a + rows, "right") - 1
        b = int(starts[i]) if starts[i] > a else int(starts[i + 1]) if i + 1 < len(starts) else end
        if len(starts) == i + 1 and end - a <= rows:
            b = end
        yield a, b
        a = b


def _target_vectors(words: WordNet, kind: int, counts: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Target vectors and biases (less the word's log share) of words of one class, by noise-contrastive estimation inside the class.

    ``met``: how often each word followed each state. Every step takes all occurrences and one
    more that is spread like the class, and the noise in expectation over all states; steps are
    Newton's with twice the information at the start, where words do not depend on the state,
    and end when no vector moves by ``SETTLED``.
    """
    share = words.state_share[kind]
    inputs = np.hstack([words.states, np.ones((STATES, 1))])
    prior = np.r_[np.full(words.states.shape[1], TARGET_PRIOR), 0].astype(np.float32)
    values, axes = np.linalg.eigh(NOISE / (1 + NOISE) * (inputs.T * share) @ inputs)
    share, inputs, axes = (x.astype(np.float32) for x in (share, inputs, axes))
    n = counts[:, None].astype(np.float32) + 1
    v, turned = np.zeros((len(n), inputs.shape[1]), np.float32), np.ascontiguousarray(inputs.T)
    true = met + share
    every = true + NOISE * n * share
    damped = 2 * n * np.maximum(values, 0).astype(np.float32) + TARGET_PRIOR
    for _ in range(WORD_STEPS):
        found = v @ turned
        np.clip(found, -30, 30, out=found)
        np.exp(-found, out=found)
        g = (true - every / (1 + NOISE * found)) @ inputs - prior * v
        step = (g @ axes / damped) @ axes.T
        v += step
        if np.abs(step).max() < SETTLED:
            break
    return v[:, :-1], v[:, -1]


def _trained(group: pa.Table, model: Model) -> pa.Table:
    """The vectors of the words of one bucket, the part of its classes' normalisers, and which chunk has which word where."""
    group = group.combine_chunks()
    lots = group["words"].combine_chunks()
    names = lots.flatten().cast(pa.binary()).dictionary_encode()
    rows, lots = group.drop_columns("words").to_pylist(), np.cumsum(pc.list_value_length(lots).to_numpy())[:-1]
    kinds, at = class_of(names.dictionary, model.heads), names.indices.to_numpy()
    times = np.concatenate([np.frombuffer(r["times"], np.int32) for r in rows]).astype(np.int64)
    counts = np.bincount(at, times, len(kinds)).astype(np.int64)
    # Words by class and name, whatever the chunks; those never taught have no vectors.
    order = pc.sort_indices(names.dictionary).to_numpy()
    order = order[counts[order] > 0]
    order = order[np.argsort(kinds[order], kind="stable")].astype(np.int64)
    number = np.full(len(kinds), -1)
    number[order] = np.arange(len(order))
    kinds, counts, at = kinds[order], counts[order], number[at]
    net, before, as_last, as_second = model.words, Pairs(), Pairs(), Pairs()
    for row, n in zip(rows, np.split(at, lots)):
        around = np.frombuffer(zlib.decompress(row["around"]), np.uint32)
        word = np.repeat(n, np.frombuffer(row["times"], np.int32)).astype(np.uint64)
        two, one, after, later = (around >> shift & np.uint32(255) for shift in (24, 16, 8, 0))
        before.add(word, two, one)
        as_last.add(word, one, after)
        more = later != 255
        as_second.add(word[more], after[more], later[more])
    q, q_scale = _rounded(_context_vectors(net, kinds, counts, as_last, as_second))
    met = np.zeros((len(order), STATES), np.float32)
    for w, two, one, times, own in before.blocks():
        of = net.state_of.take(two * CLASSES + one, 0)
        of *= times
        met[w[own]] = np.add.reduceat(of, own)
    r, r_scale = np.zeros((len(order), net.states.shape[1]), np.int8), np.ones(len(order), np.float16)
    bias, norm = np.zeros(len(order), np.float16), np.zeros((CLASSES, STATES))
    for k in np.unique(kinds):
        of = np.flatnonzero(kinds == k)
        of = of[np.argsort(counts[of], kind="stable")]  # rare words settle in fewer steps
        for part in np.array_split(of, -(-len(of) // 2_000)):
            v, b = _target_vectors(net, k, counts[part], met[part])
            r[part], r_scale[part] = _rounded(v)
            bias[part] = b
            norm[k] += np.exp(_in_states(model, k, counts[part], r[part], r_scale[part], bias[part])).sum(axis=0, dtype=float)
    held = []
    for row, n in zip(rows, np.split(at, lots)):
        known = n >= 0
        held.append((row["of"], np.frombuffer(row["pos"], np.int32)[known].tobytes(), n[known].astype(np.int32).tobytes()))
    of, pos, number = zip(*held)
    give_back()
    flat = {"counts": counts, "q": q, "q_scale": q_scale, "r": r, "r_scale": r_scale, "bias": bias}
    return pa.table({"norm": pa.array([norm.ravel().tolist()]), "of": [of], "pos": [pos], "number": [number]} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in flat.items()})


def _in_states(model: Model, kinds: np.ndarray | int, counts: np.ndarray, r: np.ndarray, scale: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Scores of words in every state."""
    out = (r * scale[:, None].astype(np.float32)) @ model.words.states.T.astype(np.float32)
    out += (bias + np.log((counts + 1) / model.mass[kinds])).astype(np.float32)[:, None]
    return out


#: Columns of word vectors: kind and numbers per word.
VECTORS = {"counts": ("<i8", 0), "q": ("i1", WIDTH), "q_scale": ("<f2", 0), "r": ("i1", WIDTH), "r_scale": ("<f2", 0), "bias": ("<f2", 0)}


def _vectors(row: dict) -> dict[str, np.ndarray]:
    return {c: x.reshape(-1, n) if n else x for c, (kind, n) in VECTORS.items() for x in [np.frombuffer(row[c], kind)]}


def word_vectors(chunks: DataFrame, shared: Broadcast[Model]) -> tuple[DataFrame, np.ndarray]:
    """Own vectors of every word in training that is not frequent, one row per bucket of words, and the normalisers by class and state.

    All occurrences of a word meet in its bucket, as the classes around them; buckets grow in
    number with the corpus. Only the normalisers, of a fixed size, reach the driver.
    """
    rows = chunks.agg(F.sum(F.size("words"))).first()[0] or 0
    buckets = max(1, -(-rows // BUCKET_ROWS))
    met = chunks.select("chunk", "words", "held", "sizes", "text").mapInArrow(
        lambda batches: _met(batches, shared.value.heads, buckets), "bucket int, of long, words array<binary>, pos binary, times binary, around binary"
    )
    schema = f"norm array<double>, of array<long>, pos array<binary>, number array<binary>, {', '.join(f'{c} binary' for c in VECTORS)}"
    blocks = written(met.groupBy("bucket").applyInArrow(lambda group: _trained(group, shared.value), schema))
    norm = np.zeros(CLASSES * STATES)
    for i, x in blocks.select(F.posexplode("norm").alias("i", "x")).groupBy("i").agg(F.sum("x")).collect():
        norm[i] = x
    return blocks, norm.reshape(CLASSES, STATES)


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of a bucket's words for every chunk that has some of them."""
    for batch in batches:
        for row in batch.to_pylist():
            vectors = _vectors(row)
            for of, pos, number in zip(row["of"], row["pos"], row["number"]):
                n = np.frombuffer(number, np.int32)
                yield pa.RecordBatch.from_pydict({"of": pa.array([of], pa.int64()), "pos": [pos]} | {c: [x[n].tobytes()] for c, x in vectors.items()})


def _classed(batches: Iterator[pa.RecordBatch], heads: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Chunks with the classes of their words in place of the words."""
    for batch in batches:
        kinds = pa.array([class_of(words.values, heads).astype(np.uint8).tobytes() for words in batch["words"]], pa.binary())
        columns = {"chunk": batch["chunk"], "kinds": kinds} | {c: batch[c] for c in ("ids", "held", "sizes", "text")}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | float, np.ndarray]:
    """exp(x - top) with ``top`` and the sums by row; ``top`` is 0 as long as no row is out of range."""
    ones = np.ones(x.shape[1], x.dtype)
    with np.errstate(over="ignore"):
        e = np.exp(x)
    total = e @ ones
    if len(x) == 0 or (total.min() > 1e-20 and total.max() < 1e20):
        return e, 0.0, total
    top = x.max(axis=1)
    e = np.exp(x - top[:, None], out=e)
    return e, top, e @ ones


def _token_scores(classes: np.ndarray, flat: np.ndarray, starts: np.ndarray, vectors: pa.Table, model: Model, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts of a chunk's words and the score of each of its tokens (``flat``: word numbers); ``vectors`` as for ``_scores``."""
    words, net = model.words, model.words.net
    count = np.where(classes > HEADS, 0, model.tokens[classes])
    q, place = net.contexts[classes].astype(np.float32), np.full(len(classes), -1)
    inside, done = np.empty((sum(len(p.as_buffer()) // 4 for p in vectors["pos"]), STATES), np.float32), 0
    for i in range(len(vectors)):
        got = {c: vectors[c][i].as_buffer() for c in ("pos", *VECTORS)}
        at, v = np.frombuffer(got["pos"], np.int32), _vectors(got)
        count[at] = v["counts"]
        q[at] = v["q"] * v["q_scale"][:, None].astype(np.float32)
        k = classes[at]
        known = np.log((model.mass[k] - 1) / model.mass[k])  # the rest of the class is left to unseen words
        x = _in_states(model, k, v["counts"], v["r"], v["r_scale"], v["bias"])
        x += known[:, None].astype(np.float32) - np.log(np.maximum(norm, 1e-300)).astype(np.float32)[k]
        place[at] = np.arange(done, done + len(at))
        np.exp(x, out=inside[done : done + len(at)])
        done += len(at)
    own = model.word_scores(classes, count)
    last, before = _before(flat, starts, int(np.argmin(classes)))
    first, second = ((q @ m.T).astype(np.float32) for m in (net.first, net.second))
    targets, bias = net.targets.T.astype(np.float32), net.bias.astype(np.float32)
    known, token, ones = place >= 0, own[flat], np.ones(STATES, np.float32)
    for a in range(0, len(flat), SCORED):
        w, u, v = (x[a : a + SCORED] for x in (flat, last, before))
        k = classes.take(w)
        p = first.take(u, 0)
        p += second.take(v, 0)
        x = p @ targets
        x += bias
        true = x[np.arange(len(k)), k]
        _, top, total = _exp(x)
        upper = (true - top - np.log(total)).astype(float) / math.log(10)
        by_class = np.flatnonzero(~(known.take(u) | known.take(v)))
        upper[by_class] = model.table[classes[v[by_class]], classes[u[by_class]], k[by_class]]
        t = np.flatnonzero(known.take(w))
        x = p.take(t, 0) @ words.state_net
        x += words.state_bias
        x -= x.max(axis=1, keepdims=True)
        x, _, total = _exp(x)
        x *= inside.take(place[w[t]], 0)
        token[a : a + SCORED] += upper
        token[t + a] += np.log10(x @ ones / total) - own[w[t]]
    return count, token


def _scores(chunk: pa.Table, vectors: pa.Table, model: Model, norm: np.ndarray, kind: pa.DataType) -> pa.Table:
    """Scores of the texts of one chunk; ``vectors``: positions, counts and vectors of its words, a row per bucket."""
    row = {c: chunk[c][0].as_py() for c in ("kinds", "ids", "held", "sizes", "text")}
    size = np.array(row["sizes"], np.int64)
    starts, flat = _starts(size), _numbers(row["text"])
    count, token = _token_scores(np.frombuffer(row["kinds"], np.uint8).astype(np.int64), flat, starts, vectors, model, norm)
    base = np.log10((count + 1) / (model.total + model.kinds + 1))
    added = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has its end
    give_back()
    return pa.table({
        "id": pa.array(row["ids"], kind), "held_out": row["held"], "n_tokens": size, "n_known": np.add.reduceat((count > 0)[flat], starts, dtype=np.int64),
        "train_tokens": np.full(len(size), model.total), "base_score": added(base[flat]), "score": added(token),
    })


def score(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    Rows that are not held out teach. A token's probability is that of its class after the two
    words before it (log-bilinear in the words' own vectors, normalised over all classes) times
    that of the word inside its class. Frequent words are classes of their own. Any other word
    of the training texts has a context vector, a target vector and a bias of its own, however
    rare: inside the class its score in a state of the context is log-bilinear and normalised
    over all words of the class, and the two words before it weigh the states. One place of a
    class (add-one) is for all its unseen words, which stand in a context by their class. So
    the probabilities of all words, the end and one unseen word per class add up to 1 after any
    context. ``base_score`` is the add-one unigram score. Texts become chunks of word numbers
    once; all occurrences of a word are trained on in its bucket, and a chunk meets its words'
    counts and vectors in one group of bounded size. Null texts are empty and have the end
    alone. Repeated rows stay repeated and teach again.
    """
    chunks = chunked(docs, id, text)
    kind = docs.schema[id].dataType
    parts = chunks.select(F.explode(F.arrays_zip("words", "taught")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.taught").alias("n"))
    counts = written(parts.groupBy("word").agg(F.sum("n").alias("c")))
    model = learn(chunks, counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    blocks, norm = word_vectors(chunks, shared)
    named = blocks.drop("norm").mapInArrow(_sent, f"of long, pos binary, {', '.join(f'{c} binary' for c in VECTORS)}")

    def together(chunk: pa.Table, vectors: pa.Table) -> pa.Table:
        return _scores(chunk, vectors, shared.value, norm, chunk.schema.field("ids").type.value_type)

    schema = f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rows = "chunk long, kinds binary, " + ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in ("ids", "held", "sizes", "text"))
    classed = chunks.drop("taught").mapInArrow(lambda batches: _classed(batches, shared.value.heads), rows)
    return classed.groupBy("chunk").cogroup(named.groupBy("of")).applyInArrow(together, schema)


@query("op8_lm")
def op8_lm(spark, sf):
    """Scores of every document."""
    return score(table(spark, sf, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
