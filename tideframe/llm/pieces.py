"""SentencePiece encoding, decoding and sampled segmentations without replacement."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import col, give_back, query, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters whose lattices are held at once.
SLICE_CHARS = 1_000_000
#: Edges of the lattices of distinct chunks that a task remembers (some 40 bytes each).
REMEMBERED_EDGES = 3_000_000

# No piece crosses the start of a run of blanks, nor a line end.
_CHUNK = re.compile("▁*[^▁\n]+|\n|▁+")
_NONE = -np.inf
#: Strides of the counters that decide draws.
DRAW, STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Nodes from the start of a tail that are looked at first for the next branch.
WINDOW = 16


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit counters into independent-looking bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _salted(keys: np.ndarray, salt, stride: int) -> np.ndarray:
    more = np.atleast_1d(salt).astype(np.uint64)
    more += np.uint64(1)
    more *= np.uint64(stride)
    return keys + more


def _fraction(counters: np.ndarray) -> np.ndarray:
    """A number between 0 and 1 that only the counter decides."""
    out = (_mix(counters) >> np.uint64(11)).astype(np.float64)
    out *= 2.0**-53
    out += 2.0**-54
    return out


def _uniform(keys: np.ndarray, draw: int, step) -> np.ndarray:
    """A number between 0 and 1 that only the key, the draw and its step decide."""
    return _fraction(_salted(_salted(keys, draw, DRAW), step, STEP))


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for counts[0] places, and so on."""
    total = int(counts.sum())
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``values[places]`` for places that are there: clipping spares the check of each, which takes most of the time."""
    return values.take(places, mode="clip")


class Vocabulary:
    """Pieces of a model with log probabilities, as a trie over characters.

    The scores of a unigram model are log probabilities. Those of a BPE model are negative
    ranks of merges; rank r then weighs 1/(r + 1), normalised. ``sharpness`` multiplies
    the log probabilities. A character without a piece of its own is spelled in byte pieces,
    each as likely as the rarest piece.
    """

    def __init__(self, path: str, sharpness: float):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        normal = [i for i in range(size) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        pieces = {self.model.id_to_piece(i): i for i in normal}
        scores = np.array([self.model.get_score(i) for i in range(size)])
        if scores[normal].min() < -1000:  # ranks
            order = sorted(normal, key=lambda i: (-scores[i], i))
            scores = np.zeros(size)
            scores[order] = -np.log(np.arange(1, len(order) + 1))
            scores[order] -= np.log(np.exp(scores[order]).sum())
        self.logp = scores * sharpness
        self.byte_logp = float(self.logp[normal].min())
        self.bytes = np.array([self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.spelled = [b""] * size
        for p, i in pieces.items():
            self.spelled[i] = p.replace("▁", " ").encode()
        for b, i in enumerate(self.bytes.tolist()):
            if self.model.is_byte(i):
                self.spelled[i] = bytes([b])
        self.spelling = pa.array(self.spelled, pa.large_binary())
        self.single = np.full(0x110000, -1, np.int32)
        self.kind = np.zeros(0x110000, np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        long = sorted(p for p in pieces if len(p) > 1)
        for n, c in enumerate(sorted({c for p in long for c in p}), 1):
            self.kind[ord(c)] = n
        # Pairs of ASCII characters that no piece holds, by the two bytes: between them every segmentation is cut.
        self.apart = np.zeros((256, 256), bool)
        self.apart[:128, :128] = True
        unused = [self.model.id_to_piece(i) for i in range(size) if self.model.is_unused(i)]  # merges may pass through them
        for a, b in {p[n : n + 2] for p in [*long, *unused] for n in range(len(p) - 1)}:
            if a < "\x80" > b:
                self.apart[ord(a), ord(b)] = False
        prefixes = sorted({p[:n] for p in long for n in range(len(p))}, key=lambda x: (len(x), x))
        number = {p: n for n, p in enumerate(prefixes)}  # prefixes with something behind them come first
        for p in long:
            number.setdefault(p, len(number))
        self.inner = len(prefixes)
        self.child = np.zeros((self.inner, int(self.kind.max()) + 1), np.uint16 if len(number) < 1 << 16 else np.int32)
        self.piece = np.full(len(number), -1, np.int32)
        for p, n in number.items():
            if p:
                self.child[number[p[:-1]], self.kind[ord(p[-1])]] = n
                self.piece[n] = pieces.get(p, -1) if len(p) > 1 else -1
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.cuts = np.zeros(0, np.int32), np.zeros(1, np.int64)  # pieces of the known chunks one after the other
        self.lattice, self.last = Lattice(self), ()

    def chunks(self, text: str | None) -> list[str]:
        return _CHUNK.findall(self.model.normalize(text or ""))

    def _alone(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The model's own segmentation of each chunk, and where each one's ends."""
        line, found, counts = int(self.bytes[10]), [], np.ones(len(chunks), np.int64)
        plain = np.array([c != "\n" for c in chunks], bool)
        words = [c for c in chunks if c != "\n"]
        for at in range(0, len(words), 1_000):
            # A line end belongs to no longer piece, so chunks on lines of their own are encoded as inside a text.
            ids = self.model.encode_as_numpy("\n" + "\n".join(words[at : at + 1_000]).replace("▁", " ") + "\n")
            found.append(ids)
        ends = [np.flatnonzero(ids == line) for ids in found]
        counts[plain] = np.concatenate([*(np.diff(e) - 1 for e in ends), np.zeros(0, np.int64)])
        cuts = np.cumsum(counts)
        out = np.full(int(counts.sum()), line, np.int32)
        body = np.repeat(plain, counts)
        out[body] = np.concatenate([*(np.delete(ids[e[0] : e[-1]], e[:-1] - e[0]) for ids, e in zip(found, ends)), np.zeros(0, np.int32)])
        return out, cuts

    def learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of distinct chunks in ``lattice``, and the pieces of all chunks there with their cuts.

        Chunks met before are looked up. Once REMEMBERED_EDGES are reached, further chunks stay only until other ones are asked for.
        """
        if self.last and self.last[0] is chunks:
            return self.last[1]
        self.lattice.cut_back(len(self.known))
        number = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        fresh = np.flatnonzero(number < 0)
        ids, cuts = self.ids, self.cuts
        if len(fresh):
            new = [chunks[i] for i in fresh.tolist()]
            number[fresh] = len(self.known) + np.arange(len(fresh))
            more, ends = self._alone(new)
            ids, cuts = np.concatenate([ids, more]), np.concatenate([cuts, cuts[-1] + ends])
            self.lattice.add(new)
            if self.lattice.edges <= REMEMBERED_EDGES:  # the chunks met first are the frequent ones
                self.known.update(zip(new, number[fresh].tolist()))
                self.ids, self.cuts = ids, cuts
        self.last = chunks, (number, ids, cuts)
        return self.last[1]

    def decode(self, ids: list[int]) -> str:
        """The text of pieces, without the blank put before it; broken byte pieces become U+FFFD."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def spell(self, rows: list[np.ndarray]) -> list[bytes]:
        """The bytes of many rows of pieces at once, with the blank put before each text."""
        out = self.spelling.take(pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]), pa.int32()))
        ends = np.frombuffer(out.buffers()[1], np.int64, len(out) + 1)[np.cumsum([0, *map(len, rows)])].tolist()
        letters = out.buffers()[2]
        return [letters[a:b].to_pybytes() if b > a else b"" for a, b in zip(ends, ends[1:])]


class Slice:
    """Some normalised texts, whole or in chunks, as places of chunks among their distinct chunks.

    With a vocabulary, chunks are cut further where none of its pieces crosses. ``inside``
    and ``offset`` still name the uncut chunk, from 1 on, and the characters before the place in it.
    """

    def __init__(self, texts: list[str] | list[list[str]], vocab: Vocabulary | None = None):
        raw = [(t if isinstance(t, str) else "".join(t)).encode() for t in texts]
        cuts = np.cumsum([0, *map(len, raw)])
        data = b"".join(raw)
        letters = np.frombuffer(data + b"\0\0", np.uint8)
        blank = (letters[:-2] == 0xE2) & (letters[1:-1] == 0x96) & (letters[2:] == 0x81)
        line = letters[:-2] == 0x0A
        begins = blank | line
        begins[3:] &= ~blank[:-3] | line[3:]  # only the first of some blanks
        begins[1:] |= line[:-1]
        begins[cuts[:-1][cuts[1:] > cuts[:-1]]] = True
        if vocab:
            cut = begins.copy()
            cut[1:] |= _at(vocab.apart.reshape(-1), letters[:-3].astype(np.uint16) << 8 | letters[1:-2])
        starts = np.flatnonzero(cut if vocab else begins)
        found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        self.flat = found.indices.to_numpy().astype(np.int64)
        self.chunks = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = np.searchsorted(starts, cuts)
        self.many = np.diff(places)  # chunks of each text
        whole = _at(begins, starts)
        chunk = np.cumsum(whole)
        first = chunk[np.minimum(places[:-1], len(starts) - 1)] if len(starts) else places[:-1]
        self.inside = chunk - np.repeat(first, self.many) + 1
        lengths = _at(np.fromiter(map(len, self.chunks), np.int64, len(self.chunks)), self.flat)
        offset = np.cumsum(lengths) - lengths
        self.offset = offset - _at(offset[whole], chunk - 1)

    def encode(self, vocab: Vocabulary) -> list[np.ndarray]:
        """Piece ids of every text by the model's own segmentation."""
        number, ids, cuts = vocab.learn(self.chunks)
        place = _at(number, self.flat)
        each = cuts[place + 1] - cuts[place]
        flat = _at(ids, _ranges(cuts[place], each))
        cuts = np.r_[0, np.cumsum(each)][np.r_[0, np.cumsum(self.many)]]
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def vocabulary(path: str, sharpness: float = 1.0) -> Vocabulary:
    return Vocabulary(path, sharpness)


class Lattice:
    """All segmentations of chunks: edges per character, with probabilities that add up to 1. Chunks are added behind those there."""

    #: Columns of edges and of characters; the rows behind ``edges`` and ``places`` are spare. ``then`` is the
    #: character behind an edge, -1 at the end of its chunk; ``id`` is ~c for a character c spelled in byte pieces.
    EDGE = {"then": np.int32, "id": np.int32, "logp": np.float64, "ladder": np.float64}
    PLACE = {"first": np.int64}

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.edges = self.places = 0
        for name, kind in (self.EDGE | self.PLACE).items():
            setattr(self, name, np.zeros(1, kind))
        self.chunk_start, self.chunk_end = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def start(self, edge: np.ndarray) -> np.ndarray:
        """The characters that edges leave from."""
        return np.searchsorted(self.first[: self.places + 1], edge, side="right") - 1

    def cut_back(self, chunks: int) -> None:
        """Forget all but the first chunks."""
        self.places = int(self.chunk_end[chunks - 1]) + 1 if chunks else 0
        self.edges = int(self.first[self.places])
        self.chunk_start, self.chunk_end = self.chunk_start[:chunks], self.chunk_end[:chunks]

    def _put(self, kinds: dict, at: int, **rows: np.ndarray) -> None:
        for name, more in rows.items():
            held = getattr(self, name)
            if at + len(more) > len(held):
                held = np.concatenate([held[:at], np.empty(len(more) + at // 4, kinds[name])])
                setattr(self, name, held)
            held[at : at + len(more)] = more

    def add(self, chunks: list[str]) -> None:
        vocab = self.vocab
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        chunk_end = np.cumsum(lengths + 1) - 1  # each chunk's end is a place without edges
        chars = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(chars)
        inner = np.ones(n, bool)
        inner[chunk_end] = False
        within = np.flatnonzero(inner)
        kind = _at(vocab.kind, chars)
        kind[chunk_end] = 0
        ids = _at(vocab.single, chars)
        spelled = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        cost = np.where(ids >= 0, vocab.logp[ids], spelled * vocab.byte_logp)
        alone = np.flatnonzero((ids < 0) & (spelled == 1))
        ids[alone] = vocab.bytes[chars[alone]]
        found = [(within, 1, ids[within])]
        at, node, depth = np.arange(n), _at(vocab.child[0], kind), 1
        while len(at):
            on = np.flatnonzero((node > 0) & (node < vocab.inner))
            at = _at(at, on)
            node = vocab.child[_at(node, on), _at(kind, at + depth)]
            depth += 1
            piece = _at(vocab.piece, node)  # none at the root
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                found.append((_at(at, hit), depth, _at(piece, hit)))
        count = np.zeros(n, np.int64)
        for start, *_ in found:
            count[start] += 1
        firsts = np.r_[0, np.cumsum(count)]
        total = int(firsts[-1])
        starts, pieces, ends = np.repeat(np.arange(n), count), np.empty(total, np.int32), np.empty(total, np.int64)
        filled = firsts[:-1].copy()
        for start, length, piece in reversed(found):  # the longest first: it is mostly the likeliest
            to = _at(filled, start)
            filled[start] = to + 1
            pieces[to], ends[to] = piece, start + length
        logw, final = _at(vocab.logp, pieces), firsts[1:][within] - 1
        logw[final] = cost[within]
        missing = np.flatnonzero(ids[within] < 0)
        pieces[final[missing]] = ~chars[within[missing]]
        # Log mass of all ways from a character to the end of its chunk, from the ends backwards.
        ahead = np.repeat(chunk_end, lengths) - within
        order = within[np.argsort(ahead.astype(np.uint16) if lengths.max() < 1 << 16 else ahead, kind="stable")]
        steps = np.r_[0, np.cumsum(np.bincount(ahead)[1:])]
        mass, wide = np.zeros(n), count[order]
        edges = _ranges(firsts[order], wide)
        goal, weight, cuts = _at(ends, edges), _at(logw, edges), np.r_[0, np.cumsum(wide)]
        for a, b in zip(steps[:-1], steps[1:]):
            if a < b:
                value = weight[cuts[a] : cuts[b]] + _at(mass, goal[cuts[a] : cuts[b]])
                runs = cuts[a:b] - cuts[a]
                top = np.maximum.reduceat(value, runs)
                value -= np.repeat(top, wide[a:b])
                mass[order[a:b]] = top + np.log(np.add.reduceat(np.exp(value, out=value), runs))
        logp = logw + _at(mass, ends) - _at(mass, starts)
        ladder = np.cumsum(np.exp(logp))
        ladder -= _at(np.r_[0, ladder], _at(firsts, starts))
        ladder[final] = 1.0  # rounding never leads past the last edge of a character
        at, to = self.places, self.edges
        self._put(self.EDGE, to, then=np.where(_at(inner, ends), ends + at, -1), id=pieces, logp=logp, ladder=ladder)
        self._put(self.PLACE, at, first=firsts + to)
        self.chunk_start, self.chunk_end = np.r_[self.chunk_start, at + chunk_end - lengths], np.r_[self.chunk_end, at + chunk_end]
        self.places, self.edges = at + n, to + total

    def draw(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each character in proportion to its probability."""
        edge = _at(self.first, place)
        on = np.flatnonzero(u >= _at(self.ladder, edge))
        more, u = _at(edge, on), _at(u, on)
        while len(on):
            more += 1
            edge[on] = more
            left = np.flatnonzero(u >= _at(self.ladder, more))
            on, more, u = _at(on, left), _at(more, left), _at(u, left)
        return edge

    def ids_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the ids of edges, byte pieces written out, and where those of each edge begin."""
        missing = np.flatnonzero(ids < 0)
        if not len(missing):
            return ids, np.arange(len(ids) + 1)
        counts = np.ones(len(ids), np.int64)
        chars = ~ids[missing]
        counts[missing] = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        out = np.repeat(ids, counts)
        out[out < 0] = self.vocab.bytes[np.frombuffer("".join(map(chr, chars.tolist())).encode(), np.uint8)]
        return out, np.r_[0, np.cumsum(counts)]


def _paths(lattice: Lattice, place: np.ndarray, counters: np.ndarray, lead: np.ndarray | int = 0, spare: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draws a path from every row's place to the end of its chunk, all rows a piece at a time: (lengths, starts, edges).

    The rows' edges follow one another, moved by ``lead`` to leave ``spare`` places free in all.
    """
    length, live, drawn = np.zeros(len(place), np.int64), np.arange(len(place)), []
    while len(live):
        edge = lattice.draw(place, _fraction(counters + place.view(np.uint64) * np.uint64(STEP)))
        drawn.append((live, edge))
        length[live] = len(drawn)
        place = _at(lattice.then, edge)
        on = np.flatnonzero(place >= 0)
        live, place, counters = _at(live, on), _at(place, on).astype(np.int64), _at(counters, on)
    ends = np.cumsum(length)
    starts = ends - length + lead
    edges = np.empty((int(ends[-1]) if len(ends) else 0) + spare, np.int64)
    for step, (live, edge) in enumerate(drawn):
        edges[_at(starts, live) + step if step else starts] = edge
    return length, starts, edges


def _top(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per run its n largest values with their places, -inf where there are no more; changes ``values``."""
    out = []
    full = np.flatnonzero(counts)
    cuts = starts[full]
    for _ in range(n):
        best, place = np.full(len(counts), _NONE), np.zeros(len(counts), np.int64)
        if len(full):
            top = np.maximum.reduceat(values, cuts)
            hits = np.flatnonzero((values == np.repeat(top, counts[full])) & (values > _NONE))
            owner = np.searchsorted(cuts, hits, side="right") - 1
            one = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
            best[full[owner[one]]], place[full[owner[one]]] = values[hits[one]], hits[one]
            values[hits[one]] = _NONE
        out.append((best, place))
    return out


def sample(texts: Slice, keys: np.ndarray, vocab: Vocabulary, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text ``k`` distinct segmentations, or all if there are fewer: (ids, log probability, Gumbel value, log inclusion).

    Top-down perturbed search: the set of all segmentations of a text has a Gumbel value; a
    drawn path inherits it, and at every node of the path the segmentations that leave it
    there get the next largest value, truncated at the path's. The best such node is where the
    next segmentation leaves. So segmentations come in falling order of their perturbed log
    probabilities, as if each had been perturbed alone. The inclusion score is the chance
    of a segmentation to be above the next value that did not come out.
    """
    many, d = texts.many, len(texts.many)
    flat, lattice = _at(vocab.learn(texts.chunks)[0], texts.flat), vocab.lattice
    last = np.cumsum(many)  # chunk places of a text: last - many up to last
    begin = _at(lattice.chunk_start, flat)
    keys = _mix(keys)
    chunk_key = _mix(np.repeat(keys, many) ^ _mix(texts.inside.astype(np.uint64)))
    chunk_key = _salted(chunk_key, texts.offset - begin, STEP)  # the place in the lattice times STEP is added for each draw

    # Of all paths: ids of edges and where each text's begin, and so on.
    paths, bases, sizes, values, logps, branches = [], [], [], [], [], []
    stored = 0
    # Branches that may come next, by their values: path, pieces before the node, edge there, chunk place, log probability before.
    agenda, notes = np.full((d, 0), _NONE), [np.zeros((d, 0), t) for t in (np.int64, np.int64, np.int64, np.int64, np.float64)]
    barred = np.full((k + 1, d, k + 1), -1, np.int64)  # per path: edges that its branching node has given away
    value = _gumbel(_uniform(keys, 0, 0))
    branch = spot_of = np.zeros(d, np.int64)
    # A path is what it keeps of its source, up to its branch, and a tail that is drawn.
    for j in range(k):
        kept_logp = np.zeros(d)
        if j == 0:
            todo = np.arange(len(flat))
            length, starts, tail = _paths(lattice, begin, _salted(chunk_key, j, DRAW))
            ends = np.r_[0, np.cumsum(length)]
            size = tail_size = ends[last] - ends[last - many]
        else:
            if not agenda.shape[1]:
                break
            pick = agenda.argmax(axis=1)
            value = agenda[np.arange(d), pick]
            live = np.flatnonzero(value > _NONE)
            agenda[live, pick[live]] = _NONE
            if not len(live):
                break
            source, branch, left, spot_of, kept_logp = (n[np.arange(d), pick] for n in notes)
            left, spot = left[live], spot_of[live]
            node = lattice.start(left)
            # The edges given away at this node: the path's own, and before it what its node had given if it branched here.
            gone = np.full((len(live), k + 1), -1, np.int64)
            same = np.stack(branches)[source[live], live] == branch[live]
            gone[same] = barred[source[live][same], live[same]]
            free = (gone == -1).argmax(axis=1)
            there = (gone == left[:, None]).any(axis=1)
            gone[np.flatnonzero(~there), free[~there]] = left[~there]
            wide = lattice.first[node + 1] - lattice.first[node]
            option = lattice.first[node][:, None] + np.arange(wide.max())
            valid = np.arange(wide.max()) < wide[:, None]
            option = np.where(valid, option, 0)
            chance = np.where(valid & ~(option[:, :, None] == gone[:, None, :]).any(axis=2), np.exp(lattice.logp[option]), 0)
            rungs = np.cumsum(chance, axis=1)
            u = _uniform(keys[live], 3 * j + 1, branch[live]) * rungs[:, -1]
            chosen = option[np.arange(len(live)), np.minimum((rungs <= u[:, None]).sum(axis=1), wide - 1)]
            free = (gone == -1).argmax(axis=1)
            gone[np.arange(len(live)), free] = chosen
            barred[j, live] = gone
            # What follows: the rest of the chunk, then the chunks behind it.
            after = wide
            then = lattice.then[chosen].astype(np.int64)
            on = np.flatnonzero(then >= 0)
            behind = last[live] - spot - (then < 0)
            todo = _ranges(last[live] - behind, behind)
            start = _at(begin, todo)
            start[(np.cumsum(behind) - behind)[on]] = then[on]
            lead = np.repeat(np.arange(1, len(live) + 1), behind)  # chosen edges of the texts up to this one
            length, starts, tail = _paths(lattice, start, _salted(_at(chunk_key, todo), j, DRAW), lead, len(live))
            ends, behind = np.r_[0, np.cumsum(length)], np.r_[0, np.cumsum(behind)]
            tail_size = np.zeros(d, np.int64)
            tail_size[live] = np.diff(ends[behind]) + 1
            tail[ends[behind[:-1]] + np.arange(len(live))] = chosen
            size = np.where(value > _NONE, branch, 0) + tail_size
        skip, base, tail_base = size - tail_size, np.cumsum(size) - size, np.cumsum(tail_size) - tail_size
        logp = _at(lattice.logp, tail)
        runs = np.zeros(len(logp) + 1)
        np.cumsum(logp, out=runs[1:])
        before = kept_logp - runs[tail_base]
        total = runs[tail_base + tail_size] + before
        path = _at(lattice.id, tail)
        if j:
            spent = np.where(barred[j, live] >= 0, np.exp(lattice.logp[np.maximum(barred[j, live], 0)]), 0).sum(axis=1)
            unspent = np.zeros(d)
            unspent[live] = np.where((barred[j, live] >= 0).sum(axis=1) < after, 1 - spent, 0)
            behind, path, tail_ids = np.ones(size.sum(), bool), np.empty(size.sum(), np.int32), path
            kept = _ranges(base[live], branch[live])
            behind[kept] = False
            path[behind] = tail_ids
            path[kept] = np.concatenate(paths)[_ranges(np.stack(bases)[source, np.arange(d)][live], branch[live])]
        # A perturbed mass lies between 3.7 below and 37.5 above its mass, so a node is beaten by k - j others
        # if the masses of any k - j nodes of its text, here the first, are larger by 42. Masses are below what
        # the pieces before the node leave, which falls along a path: mostly its beginning settles the matter.
        def masses(texts, seen):
            """Places, texts and masses of the nodes open to a branch among the first of some texts' tails."""
            nodes, who = _ranges(tail_base[texts], seen), np.repeat(texts, seen)
            rest = 1 - np.exp(_at(logp, nodes))
            if j:
                heads = (np.cumsum(seen) - seen)[seen > 0]
                rest[heads] = unspent[texts[seen > 0]]
            on = np.flatnonzero(rest > 1e-12)
            nodes, who = nodes[on], who[on]
            return nodes, who, _at(runs, nodes) + _at(before, who) + np.log(rest[on])

        lowest, seen, few = np.full(d, _NONE), WINDOW, np.flatnonzero(tail_size)
        while len(few):
            wide = np.minimum(tail_size[few], seen)
            nodes, who, mass = masses(few, wide)
            here = np.bincount(who, minlength=d)[few]
            enough = here >= k - j
            if enough.any():
                first, some = (np.cumsum(here) - here)[enough], np.full(enough.sum(), k - j)
                lowest[few[enough]] = np.minimum.reduceat(mass[_ranges(first, some)], np.cumsum(some) - some)
            few, seen = few[~enough & (wide < tail_size[few])], 4 * seen
        low, seen = np.zeros(d, np.int64), tail_size.copy()  # the first node behind those that matter, by bisection
        while (low < seen).any():
            mid = (low + seen) // 2
            matters = (low < seen) & (runs[tail_base + mid] + before > lowest - 43)  # 42, and 1 for rounding
            low, seen = np.where(matters, mid + 1, low), np.where(matters, seen, mid)
        nodes, who, mass = masses(np.arange(d), seen)
        near = np.flatnonzero(mass > lowest[who] - 42)
        nodes, who, mass = nodes[near], who[near], mass[near]
        if len(nodes):
            step_of = nodes - (tail_base - skip)[who]  # pieces before the node in its path
            drawn = mass + _gumbel(_uniform(keys[who], 3 * j + 2, step_of))
            bound = -np.logaddexp(-value[who], -drawn)
            here = np.bincount(who, minlength=d)
            for best, place in _top(bound, np.cumsum(here) - here, here, k - j):
                at = nodes[place]
                head = at == tail_base if j else np.zeros(d, bool)
                spot = np.where(head, spot_of, todo[np.maximum(np.searchsorted(starts, at, side="right") - 1, 0)] if len(todo) else 0)
                more = np.full(d, j), step_of[place], tail[at], spot, np.where(at == tail_base, kept_logp, runs[at] + before)
                agenda, notes = np.c_[agenda, best], [np.c_[n, m] for n, m in zip(notes, more)]
        paths.append(path)
        bases.append(base + stored)
        sizes.append(size)
        stored += len(path)
        values.append(value)
        logps.append(total)
        branches.append(branch)
    next_value = agenda.max(axis=1, initial=_NONE)
    out: list[list] = [[] for _ in range(d)]
    for path, base, size, value, total, offset in zip(paths, bases, sizes, values, logps, np.cumsum([0] + [len(p) for p in paths])):
        ids, cuts = lattice.ids_of(path)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            gap = total - next_value
            inclusion = np.where(next_value == _NONE, 0.0, np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700))))))
        for i in np.flatnonzero(value > _NONE):
            a, b = base[i] - offset, base[i] - offset + size[i]
            out[i].append((ids[cuts[a] : cuts[b]], float(total[i]), float(value[i]), float(inclusion[i])))
    return out


def row_keys(keys: list, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(x), seed) for x in keys], np.uint64)


def _slices(texts: pa.Array, vocab: Vocabulary) -> Iterator[tuple[int, Slice]]:
    """First row and chunks of about SLICE_CHARS characters of texts at a time."""
    held, size, first = [], 0, 0
    for t in texts:
        text = t.as_py() or ""
        held.append(vocab.model.normalize(text))
        size += len(text)
        if size >= SLICE_CHARS:
            yield first, Slice(held, vocab)
            held, size, first = [], 0, first + len(held)
    if held:
        yield first, Slice(held, vocab)


def _listed(rows: list[np.ndarray]) -> pa.Array:
    cuts = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]), pa.int32()))


def encode(text: Column, model: str = MODEL) -> Column:
    """Piece ids of the model's own segmentation; null and empty texts have none."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        vocab = vocabulary(model)
        return _listed([row for _, part in _slices(texts, vocab) for row in part.encode(vocab)])

    return ids(text)


def decode(ids: Column, model: str = MODEL) -> Column:
    """The text of piece ids; null ids give null."""

    @F.arrow_udf("string")
    def text(rows: pa.Array) -> pa.Array:
        return pa.array([None if not r.is_valid else vocabulary(model).decode(r.values.to_numpy(zero_copy_only=False).tolist()) for r in rows], pa.string())

    return text(ids)


SAMPLE = pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("gumbel", pa.float64()), ("log_inclusion", pa.float64())])
ADDED = "pieces array<int>, samples array<struct<ids:array<int>,log_prob:double,gumbel:double,log_inclusion:double>>, decodes boolean"


def segment(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 4, sharpness: float = 1.0, seed: int = 0, model: str = MODEL) -> DataFrame:
    """``docs`` with the model's segmentation, ``k`` distinct sampled ones, and whether both decode to the text.

    ``pieces``: ids of the model's own segmentation. ``samples``: structs of piece ids, log
    probability, Gumbel value and the log of the inclusion score, the largest Gumbel value
    first. The row key and the seed decide the draws, so equal rows get equal samples wherever
    they run. A text with fewer segmentations has all of them, each sure to be included; an
    empty or null text has the empty one. ``decodes``: ``pieces`` and the first sample give
    back the text, in which a literal U+2581 counts as a blank. Columns of these names are
    replaced. Work is per row, so nothing is shuffled; a task holds the lattices and the
    results of about ``SLICE_CHARS`` characters at a time, or of one longer text.
    """
    kept = [c for c in docs.columns if c.lower() not in ("pieces", "samples", "decodes")]
    docs = docs.select(*map(col, kept))
    key, body = kept.index(id), kept.index(text)

    def cut(batches):
        vocab = vocabulary(model, sharpness)
        for batch in batches:
            names = row_keys(batch.column(key).to_pylist(), seed)
            for first, part in _slices(batch.column(body), vocab):
                rows = batch.slice(first, len(part.many))
                own, found = part.encode(vocab), sample(part, names[first : first + len(part.many)], vocab, k)
                flat = [s for row in found for s in row]
                numbers = [pa.array([s[i] for s in flat], pa.float64()) for i in (1, 2, 3)]
                structs = pa.StructArray.from_arrays([_listed([s[0] for s in flat]), *numbers], fields=list(SAMPLE))
                samples = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), structs)
                plain = ((t.as_py() or "").replace("▁", " ") for t in rows.column(body))
                same = [a == b == (" " + t).encode() if t else a == b == b"" for a, b, t in zip(vocab.spell(own), vocab.spell([r[0][0] for r in found]), plain)]
                yield pa.RecordBatch.from_arrays([*rows.columns, _listed(own), samples, pa.array(same)], names=[*kept, "pieces", "samples", "decodes"])
                del own, found, flat, structs, samples
            give_back()
        vocab.forget()
        give_back()

    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(ADDED).fields])
    return docs.mapInArrow(cut, schema)


#: Segmentations per document in the registered query.
K = 4


@query("op1_sentencepiece")
def op1_sentencepiece(spark, sf):
    """Digests of the model's and of four sampled segmentations of every document, and whether they decode to the text."""
    docs = segment(table(spark, sf, "documents").select("doc_id", "text"), k=K)
    field = lambda name: F.transform("samples", lambda s: s[name]).alias(name)
    hashes = F.array(*[F.xxhash64(F.get("samples", F.lit(i))["ids"]) for i in range(K)])  # compiled, which a lambda is not
    return docs.select(
        "doc_id", F.size("pieces").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), F.size("samples").alias("n_samples"),
        F.transform("samples", lambda s: F.size(s["ids"])).alias("n_sampled"), F.slice(hashes, 1, F.size("samples")).alias("sample_hashes"),
        field("log_prob"), field("gumbel"), field("log_inclusion"), "decodes",
    )
