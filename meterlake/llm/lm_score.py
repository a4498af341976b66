"""Language-model scores by online logistic context mixing.

A text is its words (A-Z lower-cased) and one end token. The ``HEAD`` most frequent training tokens (with ``LEAST_COUNT`` occurrences)
and an escape are written as Huffman codes, and each bit of a code is predicted by three predictors with
hashed contexts: the code's node alone, with the token before, with the two tokens before (whole tokens,
also beyond the head). A predictor is a table of 0 and 1 counts, gathered from all training texts. The
predictors' log-odds are mixed by a weight set that a gate picks (how sure the second and third predictor
are), and a final table refines the mixed probability. Both start as fitted on training texts and adapt to
each text as it is read: after 16, 32, 64, ... and then every ``SEGMENT`` tokens. Texts are read side by side,
one lane of weights each, so that short segments cost no more than long ones. A token beyond the head costs its
escape and its smoothed frequency among such tokens: the ``NEXT`` most frequent of them are known to the tasks, the others are found by a join on the token's hash.

A fourth predictor has contexts of the whole corpus: phrases, cut where a token's hash says so (one token in
``PHRASE``), are counted in all training texts, as a Spark table with a row for each distinct phrase. A phrase is drawn from this
table with probability ``REPEAT`` and is spelt out otherwise; a training text does not count for its own
phrases. Vocabulary and phrases thus grow with the corpus without bound; the two hashed tables grow from 2^19 to
2^21 slots, because each worker holds them.

Counts of tokens and phrases are summed in tasks, then by Spark, and no part of them beyond the
head and the ``NEXT`` tokens after it and no text passes through the driver. Tasks' tables are added in groups of at most ``FAN_IN``. The first
weights and tables are fitted to every bit of all training texts, its own count being left out: tasks count bits by gate and by the predictors'
log-odds in steps of 1/4 or 1/2, Spark adds these counts, and each gate is fitted to its sums by a task of its own.

Edge cases: null and empty texts are the end token alone; texts are read whole; repeated rows are
scored each; without training texts every token is unknown and has the smoothed probability; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.shared import _SPACE, _powers_up_to, materialize, mix, tidy

HEAD = 65_534
#: Training occurrences of a head token at least: rarer ones say how often new tokens must be expected.
LEAST_COUNT = 3
LEAST_SLOT_BITS, MOST_SLOT_BITS = 19, 21
CHUNK = 1 << 12
FAN_IN = 64
SEGMENT = 512
SAMPLE_ROWS = 1000
#: One token in PHRASE ends a phrase; a phrase is drawn whole with probability REPEAT.
PHRASE, REPEAT = 32, 1 / 32
#: Bytes and number of the texts that are read side by side.
TOGETHER, MOST_TEXTS = 1 << 18, 1000
#: Bytes of texts that are split into words at a time.
SPLIT = 1 << 16
#: Bits that are made, counted or read at a time: their arrays stay in a core's cache.
PIECE = 1 << 13
#: Steps a unit in which log-odds from -8 to 8 are told apart when bits are counted to fit the weights, by predictor.
STEPS = (4, 2, 2)
#: Tokens that are read at a time, of as many texts as that takes: enough to be worth the calls.
PART = 3072
#: Most tokens beyond the head whose counts are sent to the tasks, the most frequent ones; the rest meet theirs in a join.
NEXT = 1 << 19
#: Stands for the end token among word hashes.
END = np.uint64(0x0E4D0E4D0E4D0E4D)
#: How firmly a text starts from the fitted weights and table: curvature counted before its first bit.
_HOLD, _HOLD_CELLS = 30, 8
_FIRST = np.array([0.4, 0.35, 0.35, 0.0])
_GRID = np.linspace(-8, 8, 33)
_CELLS = len(_GRID)


_WORD = (~_SPACE).tobytes()


def tokens(data: bytes, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts put end to end, and where each text's start; ``first`` has the texts' places in ``data``. Words hash as in ``word_hashes``."""
    data = data.lower()
    word = np.frombuffer(data.translate(_WORD), bool)
    begins, ends = word.copy(), word.copy()
    np.greater(word[1:], word[:-1], out=begins[1:])
    np.greater(word[:-1], word[1:], out=ends[:-1])
    edges = first[first < len(data)]  # no word goes on from one text to the next
    begins[edges] = word[edges]
    edges = edges[edges > 0] - 1
    ends[edges] = word[edges]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers_up_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    values = np.add(np.frombuffer(data, np.uint8), 1, dtype=np.uint64)
    values *= up[: len(data)]
    np.cumsum(values, out=sums[1:])
    before = np.searchsorted(begins, first)
    starts = before + np.arange(len(first))
    h = np.full(len(begins) + len(first), END)
    is_word = np.ones(len(h), bool)
    is_word[np.append(starts[1:], len(h)) - 1] = False
    h[is_word] = mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    return h, starts


def phrases(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the phrases of texts put end to end."""
    last = mix(h ^ np.uint64(0x5EED)) < np.uint64((1 << 64) // PHRASE)
    last[starts - 1] = True  # each text's last token, that of the last text by index -1
    edges = np.append(0, np.flatnonzero(last) + 1)
    up, down = _powers_up_to(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return edges[:-1], mix((sums[edges[1:]] - sums[edges[:-1]]) * down[edges[:-1]] + np.diff(edges).astype(np.uint64))


def huffman(weights: np.ndarray) -> dict:
    """Codes of the symbols: node and bit of each step, flat, with start and length by symbol."""
    heap = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, side, k = {}, {}, len(weights)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y], side[x], side[y] = k, k, 0, 1
        heapq.heappush(heap, (a + b, k))
        k += 1
    node, bit, start, length = [], [], [], []
    for i in range(len(weights)):
        path, at = [], i
        while at in parent:
            path.append((parent[at] - len(weights), side[at]))
            at = parent[at]
        start.append(len(node))
        length.append(len(path))
        node += [n for n, _ in reversed(path)]
        bit += [b for _, b in reversed(path)]
    return {"node": np.array(node, np.int64), "bit": np.array(bit, np.int8), "start": np.array(start, np.int64), "length": np.array(length, np.int64)}


class Listed:
    """Finds hashes in a list of different ones."""

    def __init__(self, hashes: np.ndarray, bits: int):
        # places by the first bits of the hashes; those that find theirs taken are searched for
        self.size, self.shift = len(hashes), np.uint64(64 - bits)
        self.hashes, self.place = np.append(hashes, np.uint64(0)), np.full(1 << bits, self.size, np.int32)
        self.place[(hashes >> self.shift)[::-1].view(np.int64)] = np.arange(self.size, dtype=np.int32)[::-1]
        crowded = self.place[(hashes >> self.shift).view(np.int64)] != np.arange(self.size)
        self.others = np.flatnonzero(crowded)[np.argsort(hashes[crowded])]
        self.rest = hashes[self.others]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The hashes' places in the list, its length for those that it does not have."""
        found = self.place[(h >> self.shift).view(np.int64)].astype(np.int64)
        missed = np.flatnonzero((found < self.size) & (self.hashes[found] != h))
        at = np.searchsorted(self.rest, h[missed])
        there = at < len(self.rest)
        there[there] = self.rest[at[there]] == h[missed][there]
        found[missed] = self.size
        found[missed[there]] = self.others[at[there]]
        return found


class Coder:
    """Turns token hashes into bits and the slots of their three contexts."""

    def __init__(self, hashes: np.ndarray, codes: dict, slot_bits: int):
        self.codes, self.escape, self.slot_bits = codes, len(hashes), slot_bits
        # codes of one length are the rows of a table, so that a code is looked up as a whole
        self.length, self.row, self.places = codes["length"].astype(np.uint8), np.zeros(len(codes["length"]), np.int64), {}
        for n in np.unique(codes["length"][codes["length"] > 0]).tolist():
            of = np.flatnonzero(codes["length"] == n)
            self.row[of] = np.arange(len(of))
            self.places[n] = codes["start"][of][:, None] + np.arange(n)
        # what the node adds to a hash, and the bit above the slots
        self.step = self.rows(codes["node"].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.side = self.rows(codes["bit"].astype(np.int64) << slot_bits)
        self.head = Listed(hashes, 20)

    def rows(self, values: np.ndarray) -> dict[int, np.ndarray]:
        """Values by place in the codes, as a table for each code length with a row for each code."""
        return {n: values[places] for n, places in self.places.items()}

    def symbols(self, h: np.ndarray) -> np.ndarray:
        return self.head.find(h)

    @staticmethod
    def contexts(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the token before, and of the two before, for texts put end to end."""
        before = np.concatenate(([END], h[:-1]))
        before[starts] = END
        earlier = np.concatenate(([END], before[:-1]))
        earlier[starts] = END
        one = before * np.uint64(0x9E3779B97F4A7C15)
        return one, (one ^ mix(earlier + np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F)

    def by_length(self, s: np.ndarray) -> dict[int, np.ndarray]:
        """The tokens of each code length, in their order; those without bits are left out."""
        length = self.length[s]
        order = np.argsort(length, kind="stable")
        ends = np.cumsum(np.bincount(length, minlength=max(self.places, default=0) + 1))
        return {n: order[ends[n - 1] : ends[n]] for n in self.places}

    def bits(self, s: np.ndarray, one: np.ndarray, two: np.ndarray, tokens: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Tokens of one code length at a time: the length, the tokens and their rows, and the slots of the second and third predictor, with a row of bits for each token."""
        high = np.uint64(64 - self.slot_bits)
        for n, of in tokens.items():
            for i in range(0, len(of), PIECE // n or 1):
                some = of[i : i + (PIECE // n or 1)]
                row = self.row[s[some]]
                second = self.step[n].take(row, 0, mode="clip")
                first = one[some][:, None] + second
                first *= np.uint64(0xFF51AFD7ED558CCD)
                first >>= high
                second ^= two[some][:, None]
                second *= np.uint64(0xC4CEB9FE1A85EC53)
                second >>= high
                yield n, some, row, first.view(np.int64), second.view(np.int64)


def _log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.4) / (n0 + 0.4)).astype(np.float32)


def _sure(n: np.ndarray) -> np.ndarray:
    return np.digitize(n, [1, 4, 32])


def _packed(odds: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Log-odds (to 1/256) and how sure they are in 16 bits, so that a context is looked up once."""
    return (np.rint(odds * 256).astype(np.int16) << 2) | sure.astype(np.int16)


class Lanes:
    """Gated weights and refining tables of texts read side by side; they adapt, each to its own text."""

    def __init__(self, weights: np.ndarray, table: np.ndarray, lanes: int):
        self.w = [np.tile(w, lanes).astype(np.float32) for w in weights]
        self.table = np.append(np.tile(table.ravel(), lanes), 0).astype(np.float32)  # one more, so that every place has a next one
        self.bend, self.cells = np.full(len(self.w[0]), float(_HOLD)), np.full(len(self.table) - 1, float(_HOLD_CELLS))

    def read(self, x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, learn: int, first: int, lanes: int) -> np.ndarray:
        """Natural logarithms of the bits' probabilities; ``gate`` counts through the gates of the lanes from ``first`` on. The first ``learn`` bits, which are those of the first ``lanes`` of them, are learnt from."""
        mixed = self.w[-1][16 * first :].take(gate, mode="clip")
        for w, values in zip(self.w, x, strict=False):
            part = w[16 * first :].take(gate, mode="clip")
            part *= values
            mixed += part
        np.clip(mixed, -7.99, 7.99, out=mixed)
        part = mixed + np.float32(8)
        part *= np.float32(2)
        low = np.floor(part)
        part -= low
        place = gate * _CELLS
        place += low.astype(np.int32)
        table = self.table[16 * _CELLS * first :]
        base = table.take(place, mode="clip")
        refined = table[1:].take(place, mode="clip")
        refined -= base
        refined *= part
        refined += base
        refined += mixed
        one = np.float32(1)
        refined *= np.float32(-0.5)
        p = np.exp(refined, out=refined)
        p += one
        np.divide(one, p, out=p)
        np.clip(p, 1e-6, 1 - 1e-6, out=p)
        if learn:
            self.learn([values[:learn] for values in x], *(v[:learn] for v in (gate, bit, mixed, place, p)), first, lanes)
        p += bit
        p -= one
        np.abs(p, out=p)
        return np.log(p, out=p)

    def learn(self, x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, mixed: np.ndarray, place: np.ndarray, p: np.ndarray, first: int, lanes: int) -> None:
        """Newton steps on the sums so far, with the trace for the Hessian: the more is read, the smaller they get, and they are stable. Lanes that are at their end are left out."""
        n, m, one = 16 * lanes, 16 * lanes * _CELLS, np.float32(1)
        gates, places = slice(16 * first, 16 * first + n), slice(16 * first * _CELLS, 16 * first * _CELLS + m)
        now = np.negative(mixed)
        np.exp(now, out=now)
        now += one
        np.divide(one, now, out=now)
        error, bend = bit - now, one - now
        bend *= now
        spread = x[0] * x[0]
        part = x[1] * x[1]
        spread += part
        spread += np.multiply(x[2], x[2], out=part)
        spread += one
        bend *= spread
        self.bend[gates] += np.bincount(gate, bend, n)
        for w, values in zip(self.w, x, strict=False):
            w[gates] += (np.bincount(gate, np.multiply(error, values, out=part), n) / self.bend[gates]).astype(np.float32)
        self.w[-1][gates] += (np.bincount(gate, error, n) / self.bend[gates]).astype(np.float32)
        table = self.table[places]
        np.subtract(one, p, out=part)
        part *= p
        self.cells[places] += np.bincount(place, part, m)
        table += (np.bincount(place, np.subtract(bit, p, out=part), m) / self.cells[places]).astype(np.float32)
        np.clip(table, -8, 8, out=table)


class Model:
    def __init__(self, coder: Coder, n0: list[np.ndarray], n1: list[np.ndarray], weights: np.ndarray | None = None, table: np.ndarray | None = None):
        self.coder, self.n0, self.n1 = coder, n0, n1
        # by place in the codes: the first predictor's log-odds, and the bit
        self.first = coder.rows(np.rint(_log_odds(n0[0], n1[0]) * 256)[coder.codes["node"]] * np.float32(1 / 256))
        self.bit = coder.rows(coder.codes["bit"].astype(np.float32))
        self.known = [_packed(_log_odds(a, b), _sure(a + b)) for a, b in zip(n0[1:], n1[1:], strict=True)]
        self.weights = np.tile(_FIRST[:, None], (1, 16)) if weights is None else weights
        self.table = np.tile(_GRID, (16, 1)) if table is None else table

    @staticmethod
    def order(starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray]:
        """How texts are read, longer ones before shorter ones, in segments of 16, 32, ... SEGMENT tokens, then of SEGMENT each: the tokens and their lanes in the order of reading, which is cut into parts of some lanes
        (the first, their number, and how many of them go on), and for each part where its tokens begin, where those of lanes that end begin, and where it ends."""
        by = np.argsort(-size, kind="stable")
        starts, size = starts[by], size[by]
        here, lane, parts, edges, done = [], [], [], [], 0
        a, k = 0, len(starts)
        while k:
            z = min(2 * a + 16, a + SEGMENT)
            tokens = np.minimum(size[:k], z) - a
            ends = np.append(0, np.cumsum(tokens))
            now = np.repeat(starts[:k] + a - ends[:-1], tokens)
            now += np.arange(len(now))
            here.append(now)
            lane.append(np.repeat(np.arange(k), tokens))
            goes_on = int(np.searchsorted(-size, -z))
            some = max(1, PART // (z - a))
            for i in range(0, k, some):
                j = min(k, i + some)
                go = min(max(goes_on, i), j)
                parts.append((i, j - i, go - i))
                edges.append((done + ends[i], done + ends[go], done + ends[j]))
            done += len(now)
            a, k = z, goes_on
        return np.concatenate(here), np.concatenate(lane), parts, np.array(edges)

    def log10(self, h: np.ndarray, s: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each token (hashes h, symbols s) of texts put end to end; each text has its lane."""
        here, lane, parts, edges = self.order(starts, np.diff(np.append(starts, len(h))))
        one, two = self.coder.contexts(h, starts)
        s, lane = s[here], (16 * lane).astype(np.int32)
        tokens = self.coder.by_length(s)
        # the bits of all tokens, those of one code length together
        n_bits = sum(n * len(of) for n, of in tokens.items())
        first, bit, gate = np.empty(n_bits, np.float32), np.empty(n_bits, np.float32), np.empty(n_bits, np.int32)
        second, third, a = np.empty(n_bits, np.int16), np.empty(n_bits, np.int16), 0
        for n, some, row, *slots in self.coder.bits(s, one[here], two[here], tokens):
            bits = slice(a, a + n * len(some))
            for out, table in ((first, self.first), (bit, self.bit)):
                table[n].take(row, 0, mode="clip", out=out[bits].reshape(-1, n))
            for out, table, at in zip((second, third), self.known, slots, strict=True):
                table.take(at, mode="clip", out=out[bits].reshape(-1, n))
            gate[bits].reshape(-1, n)[:] = lane[some][:, None]
            a = bits.stop
        # where the bits of each part are: of lanes that go on by code length, then of lanes that end
        starts_at = np.cumsum([0, *(n * len(of) for n, of in tokens.items())])
        where = np.array([start + n * np.searchsorted(of, edges) for start, (n, of) in zip(starts_at, tokens.items(), strict=False)]).reshape(-1, len(parts), 3)
        logs, out, every = np.empty(n_bits, np.float32), np.zeros(len(h)), Lanes(self.weights, self.table, len(starts))
        for (lane_from, lanes, go_on), cuts in zip(parts, where.transpose(1, 2, 0), strict=True):
            pieces = [slice(i, j) for k in (0, 1) for i, j in zip(cuts[k].tolist(), cuts[k + 1].tolist(), strict=True) if i < j]
            if not pieces:
                continue
            x0, x1, x2, y, g = [np.concatenate([v[piece] for piece in pieces]) for v in (first, second, third, bit, gate)]
            g += ((x1 & 3) << 2 | x2 & 3) - 16 * lane_from
            x = [x0, (x1 >> 2).astype(np.float32), (x2 >> 2).astype(np.float32)]
            for values in x[1:]:
                values *= np.float32(1 / 256)
            found, i = every.read(x, g.astype(np.int64), y, int((cuts[1] - cuts[0]).sum()), lane_from, go_on), 0
            for piece in pieces:
                j = i + piece.stop - piece.start
                logs[piece] = found[i:j]
                i = j
        for start, (n, of) in zip(starts_at, tokens.items(), strict=False):
            out[here[of]] = np.einsum("ij->i", logs[start : start + n * len(of)].reshape(-1, n))
        return out / math.log(10)


def together(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Texts that are read side by side, some hundred thousand bytes or one longer text: their places, tokens put end to end, and starts."""
    if not len(texts):
        return
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    edges, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1], texts.buffers()[2]
    a = 0
    while a < len(texts):
        z = min(max(a + 1, int(np.searchsorted(edges, edges[a] + TOGETHER, "right")) - 1), a + MOST_TEXTS, len(texts))
        parts, n, i = [], 0, a
        while i < z:
            j = min(max(i + 1, int(np.searchsorted(edges, edges[i] + SPLIT, "right")) - 1), z)
            h, starts = tokens(data.slice(edges[i], edges[j] - edges[i]).to_pybytes() if data else b"", edges[i:j] - edges[i])
            parts.append((h, starts + n))
            n, i = n + len(h), j
        yield slice(a, z), *map(np.concatenate, zip(*parts, strict=True))
        a = z


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens and of phrases."""
    with tidy():
        for b in batches:
            found = [(h, phrases(h, starts)[1]) for _, h, starts in together(b.column("text"))]
            for k, phrase in enumerate((False, True)):
                h, c = np.unique(np.concatenate([*(x[k] for x in found), np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), phrase)), pa.array(h.view(np.int64)), pa.array(c)], names=["phrase", "w", "c"])


def _pieces(coder: Coder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Of all texts the bits of some tokens of one code length: the length, the tokens' rows, and for the second and third predictor each bit's slot, those of ones after those of zeros."""
    for b in batches:
        for _, h, starts in together(b.column("text")):
            s = coder.symbols(h)
            for n, _, row, *slots in coder.bits(s, *coder.contexts(h, starts), coder.by_length(s)):
                side = coder.side[n].take(row, 0, mode="clip")
                for x in slots:
                    x += side
                yield n, row, slots


class Sums:
    """How often each number below ``n`` was added: counted in 32 bits, and moved to 64 before they could overflow."""

    def __init__(self, n: int):
        self.counts, self.sums, self.size = np.zeros(n, np.int32), None, 0

    def add(self, x: np.ndarray) -> None:
        if self.size + len(x) >= 1 << 31:
            self.sums, self.size = self.total().astype(np.int64), 0
            self.counts[:] = 0
        np.add.at(self.counts, x, np.int32(1))
        self.size += len(x)

    def total(self) -> np.ndarray:
        return self.counts if self.sums is None else self.sums + self.counts


def _gather(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy():
            coder = Coder(*shared.value)
            slots_in_all = 1 << coder.slot_bits
            sums = [Sums(2 * slots_in_all) for _ in range(2)]
            for _, _, slots in _pieces(coder, batches):
                for of, x in zip(sums, slots, strict=True):
                    of.add(x.ravel())
            for k, of in enumerate(sums):
                counts = of.total().reshape(2, -1, CHUNK)
                for i in range(0, slots_in_all // CHUNK, 32):
                    part = counts[:, i : i + 32].swapaxes(0, 1).reshape(-1, 2 * CHUNK)
                    found = np.flatnonzero(part.any(1))
                    values = [x.tobytes() for x in part[found].astype("<i8")]
                    yield pa.RecordBatch.from_arrays([pa.array(k * (slots_in_all // CHUNK) + i + found), pa.array(values, pa.binary())], names=["chunk", "counts"])

    return run


def _add(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(2 * CHUNK, np.int64)
    for x in group["counts"]:
        total += np.frombuffer(x, "<i8")
    return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "g": group["g"].iloc[:1] // FAN_IN, "counts": [total.tobytes()]})


_LEVELS = [16 * n + 1 for n in STEPS]


def _places(n0: np.ndarray, n1: np.ndarray, k: int) -> np.ndarray:
    """Of each slot what it adds to a cell: the place of its log-odds, and for the second and third predictor how sure they are; first as they are without one 0, then without one 1."""
    both, out = ((np.maximum(n0 - 1, 0), n1), (n0, np.maximum(n1 - 1, 0))), []
    for a, b in both:
        place = ((np.clip(_log_odds(a, b), -8, 8) + np.float32(8)) * STEPS[k] + np.float32(0.5)).astype(np.int32)
        out.append(place * (math.prod(_LEVELS[k + 1 :]) * 32) + (_sure(a + b) * (0, 8, 2)[k]).astype(np.int32))
    return np.concatenate(out).astype(np.uint16 if k else np.int32)


def _tally(shared):
    """Counts of bits by cell: places of the three predictors, gate and bit, mixed into one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy():
            codes, n0, n1 = shared.value
            coder = Coder(*codes)
            first, second, third = [_places(a, b, k) for k, (a, b) in enumerate(zip(n0, n1, strict=True))]
            bit = coder.codes["bit"].astype(np.int64)
            first = coder.rows((first[coder.codes["node"] + bit * len(n0[0])] + bit).astype(np.int64))
            sums = Sums(math.prod(_LEVELS) * 32)
            for n, row, slots in _pieces(coder, batches):
                cell = first[n].take(row, 0, mode="clip")
                cell += second.take(slots[0], mode="clip")
                cell += third.take(slots[1], mode="clip")
                sums.add(cell.ravel())
            sums = sums.total()
            found = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found].astype(np.int64))], names=["cell", "c"])

    return run


def _fit_gate(group: pd.DataFrame) -> pd.DataFrame:
    """Weights and refining table of one gate: Newton steps from the first values, which count as much as a text's start does."""
    group = group.sort_values("cell")
    cell, c = group["cell"].to_numpy(), group["c"].to_numpy().astype(float)
    bit, gate, place = cell & 1, int(cell[0] >> 1 & 15), cell >> 5
    places = place // (_LEVELS[1] * _LEVELS[2]), place // _LEVELS[2] % _LEVELS[1], place % _LEVELS[2]
    x = np.stack([*(p / n - 8 for p, n in zip(places, STEPS, strict=True)), np.ones(len(cell))], 1)
    first = _FIRST.astype(float)
    w = first.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (c * p * (1 - p))) @ x + _HOLD * np.eye(4), x.T @ (c * (bit - p)) - _HOLD * (w - first))
        w += step * min(1.0, 0.5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    mixed = np.clip(x @ w, -7.99, 7.99)
    low = ((mixed + 8) * 2).astype(int)
    part = (mixed + 8) * 2 - low
    table = _GRID.copy()
    for _ in range(50):
        p = np.clip(1 / (1 + np.exp(-0.5 * (table[low] + (table[low + 1] - table[low]) * part + mixed))), 1e-6, 1 - 1e-6)
        error, bend = 0.5 * c * (bit - p), 0.25 * c * p * (1 - p)
        slope, curve = -_HOLD_CELLS * (table - _GRID), _HOLD_CELLS * np.eye(_CELLS)
        for k, own in ((0, 1 - part), (1, part)):
            slope += np.bincount(low + k, error * own, _CELLS)
            for j, other in ((0, 1 - part), (1, part)):
                np.add.at(curve, (low + k, low + j), bend * own * other)
        step = np.linalg.solve(curve, slope)
        table = np.clip(table + step * min(1.0, 1 / max(np.abs(step).max(), 1e-12)), -8, 8)
        if np.abs(step).max() < 1e-6:
            break
    return pd.DataFrame({"gate": [gate], "w": [w.tolist()], "table": [table.tolist()]})


def _runs(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (owner, h), where each run of equal pairs begins in it, and the runs' lengths."""
    order = np.lexsort((h, owner))
    a, b = owner[order], h[order]
    begins = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(h)])
    return order, begins, np.diff(np.append(begins, len(h)))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy():
            coder, n0, n1, weights, table, seen, tail_most, more, more_seen, rare = shared.value
            model, after, log_more = Model(Coder(*coder), n0, n1, weights, table), Listed(more, 22), np.log10(more_seen + 1.0)
            escape, log_c = model.coder.escape, np.append(np.log10(seen + 1.0), 0.0)
            for b in batches:
                sizes = pc.fill_null(pc.binary_length(b.column("text")), 0)
                for places, h, starts in together(b.column("text")):
                    n = len(starts)
                    owner = np.repeat(np.arange(n), np.diff(np.append(starts, len(h))))
                    s = model.coder.symbols(h)
                    logs, beyond = model.log10(h, s, starts), s == escape
                    edges, names = phrases(h, starts)
                    # tokens beyond the head: those whose counts are at hand, and the others, once each in a text
                    tail, tail_owner = h[beyond], owner[beyond]
                    at = after.find(tail)
                    near = at < len(more)
                    n_near, near_logs = np.bincount(tail_owner[near], minlength=n), np.bincount(tail_owner[near], log_more[at[near]], n)
                    tail, tail_owner = tail[~near], tail_owner[~near]
                    order, begins, times = _runs(tail_owner, tail)
                    tail, tail_owner = tail[order][begins], tail_owner[order][begins]
                    # phrases, how often the text has each, and their cost when spelt out, tokens beyond the head at their least
                    order, _, often = _runs(owner[edges], names)
                    own = np.empty(len(names), np.int64)
                    own[order] = np.repeat(often, often)
                    cost = np.add.reduceat(logs + beyond * tail_most, edges)
                    everyone = np.concatenate((tail_owner, owner[edges]))
                    by = np.argsort(everyone, kind="stable")
                    offsets = pa.array(np.append(0, np.cumsum(np.bincount(everyone, minlength=n))), pa.int32())

                    def listed(values: np.ndarray, by=by, offsets=offsets) -> pa.Array:
                        return pa.ListArray.from_arrays(offsets, pa.array(values[by]))

                    head = np.add.reduceat(log_c[s], starts) + near_logs, np.add.reduceat(logs, starts) + near_logs - n_near * rare
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id")[places], b.column("train")[places], *[pa.array(x) for x in (np.bincount(owner), np.bincount(owner, ~beyond).astype(np.int64) + n_near, *head)], sizes[places].cast(pa.int64()), pa.array(np.bincount(owner[edges])),
                         listed(np.concatenate((tail, names)).view(np.int64)), listed(np.concatenate((times, own))), listed(np.concatenate((np.full(len(tail), np.nan), cost)).astype(np.float32))],
                        names=["id", "train", "n_tokens", "near_tokens", "near_base", "near_log10", "n_bytes", "n_phrases", "w", "times", "cost"],
                    )

    return run


def _sample(train: DataFrame) -> DataFrame:
    """The ``SAMPLE_ROWS`` different texts whose hashes are least (all, if there are fewer), to look at; nothing is fitted on them. Hashes are picked first, below a bound that is raised until it
    leaves enough of them; only the picked texts are moved, each once, however often it repeats."""
    hashed = train.select("text", F.xxhash64("text").alias("h"))
    rows, share = train.count(), 1.0
    if rows > 4 * SAMPLE_ROWS:
        share = 4 * SAMPLE_ROWS / rows
    while True:
        bound = min(int(-(1 << 63) + share * (1 << 64)), (1 << 63) - 1)
        least = [r.h for r in hashed.where(F.col("h") <= bound).select("h").distinct().orderBy("h").limit(SAMPLE_ROWS).collect()]
        if len(least) == SAMPLE_ROWS or share >= 1:
            break
        share = min(1.0, 8 * share)
    last = least[-1] if least else -(1 << 63)
    return hashed.where(F.col("h") <= last).dropDuplicates(["h"])


def _next(both: DataFrame, hashes: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of tokens after the head: all that occur so often that there are at most ``NEXT`` of them."""
    rest = both.where((~F.col("phrase")) & (F.col("c") <= int(seen[-1]) if len(seen) else F.lit(False)))
    # tokens with the last count of the head may be in it
    by_count = rest.groupBy("c").count().orderBy(F.desc("c")).collect()  # at most as many rows as the rarest head token has occurrences
    room, least = NEXT + int((seen == seen[-1]).sum()) if len(seen) else 0, None
    for r in by_count:
        room -= r["count"]
        if room < 0:
            break
        least = r.c
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = rest.where(F.col("c") >= least).select("w", "c").toArrow()
    w, c = found["w"].to_numpy().view(np.uint64), found["c"].to_numpy()
    new = ~np.isin(w, hashes)
    return w[new], c[new]


def score(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    train = docs.where(trainable).select(F.col(text_col).alias("text"))
    both = materialize(train.mapInArrow(_count, "phrase boolean, w long, c long").groupBy("phrase", "w").agg(F.sum("c").alias("c")))
    sizes = {r.phrase: r for r in both.groupBy("phrase").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    (n, v), drawn = ((r.n, r.v) if (r := sizes.get(False)) else (0, 0)), (sizes[True].n if True in sizes else 1)
    top = both.where((~F.col("phrase")) & (F.col("c") >= LEAST_COUNT)).orderBy(F.desc("c"), "w").limit(head).collect()  # bounded by ``head``
    hashes, seen = np.array([r.w for r in top], np.int64).view(np.uint64), np.array([r.c for r in top], np.int64)
    tail_n, tail_v = n - int(seen.sum()), v - len(top)
    more, more_seen = _next(both, hashes, seen)

    slot_bits = min(MOST_SLOT_BITS, max(LEAST_SLOT_BITS, n.bit_length() - 7))
    slots, coder = 1 << slot_bits, (hashes, huffman(np.append(seen, max(1, tail_n))), slot_bits)
    tables = train.mapInArrow(_gather(spark.sparkContext.broadcast(coder)), "chunk long, counts binary").withColumn("g", F.spark_partition_id().cast("long"))
    groups = max(1, train.rdd.getNumPartitions())
    while True:
        tables = tables.groupBy("chunk", F.floor(F.col("g") / FAN_IN)).applyInPandas(lambda group: _add(group), "chunk long, g long, counts binary")
        groups = -(-groups // FAN_IN)
        if groups == 1:
            break
    n0, n1 = [np.zeros(slots, np.int64) for _ in range(3)], [np.zeros(slots, np.int64) for _ in range(3)]
    for r in tables.toLocalIterator():  # at most 2 * slots / CHUNK rows
        (k, i), part = divmod(r.chunk, slots // CHUNK), np.frombuffer(r.counts, "<i8")
        n0[k + 1][i * CHUNK : (i + 1) * CHUNK], n1[k + 1][i * CHUNK : (i + 1) * CHUNK] = part[:CHUNK], part[CHUNK:]
    # a node's counts follow from its symbols'; the escape also stands for tokens that training does not have: as many as the smoothing of the rest counts
    codes = coder[1]
    passed = np.repeat(np.append(seen, tail_n + tail_v + 1), codes["length"])
    for n_side, side in ((n0, 0), (n1, 1)):
        np.add.at(n_side[0], codes["node"][codes["bit"] == side], passed[codes["bit"] == side])
    # shares matter, not sizes: counts are halved until the largest fits
    shift = max(0, max(int(x.max()) for x in (*n0, *n1)).bit_length() - 31)
    n0, n1 = [(x >> shift).astype(np.int32) for x in n0], [(x >> shift).astype(np.int32) for x in n1]
    counted = train.mapInArrow(_tally(spark.sparkContext.broadcast((coder, n0, n1))), "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c"))
    weights, table = np.tile(_FIRST[:, None], (1, 16)), np.tile(_GRID, (16, 1))
    by_gate = counted.groupBy(F.shiftright("cell", 1).bitwiseAND(15)).applyInPandas(lambda group: _fit_gate(group), "gate int, w array<double>, table array<double>")
    for r in by_gate.collect():  # 16 rows at most
        weights[:, r.gate], table[r.gate] = r.w, r.table

    rare = math.log10(tail_n + tail_v + 1)
    tail_most = math.log10(int(seen[-1]) + 1 if len(seen) else 1) - rare
    model = spark.sparkContext.broadcast((coder, n0, n1, weights, table, seen, tail_most, more, more_seen, rare))
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(trainable, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    found = keyed.mapInArrow(_score(model), f"id {kind}, train boolean, n_tokens long, near_tokens long, near_base double, near_log10 double, n_bytes long, n_phrases long, w array<long>, times array<long>, cost array<float>")
    scored = materialize(found.withColumn("row", F.monotonically_increasing_id()))  # numbered once, when written

    # tokens beyond those at hand (without a cost) and phrases meet their counts; what training does not have adds nothing
    parts = scored.select("row", "train", F.explode(F.arrays_zip("w", "times", "cost")).alias("x")).select("row", "train", "x.*").withColumn("phrase", F.col("cost").isNotNull() & ~F.isnan("cost"))
    own = F.when(F.col("train"), F.col("times")).otherwise(0)  # a phrase seen in one text alone is not found again by it
    ahead = F.log10((F.col("c") - own) * (REPEAT / drawn)) - F.col("cost")
    gain = F.when(ahead > 15, ahead).otherwise(F.log10(F.pow(F.lit(10.0), F.least(ahead, F.lit(15.0))) + (1 - REPEAT))) - math.log10(1 - REPEAT)
    token = ~F.col("phrase")
    met = parts.join(both, ["phrase", "w"]).where(token | (F.col("c") > own))
    met = met.groupBy("row").agg(F.sum(F.when(token, F.col("times"))).alias("known"), F.sum(F.when(token, F.col("times") * F.log10(F.col("c") + 1))).alias("logs"), F.sum(F.when(F.col("phrase"), gain)).alias("gain"))

    whole = scored.drop("w", "times", "cost").join(met, "row", "left")
    n_far, logs = F.col("n_tokens") - F.col("near_tokens"), F.coalesce("logs", F.lit(0.0))
    total = F.col("near_log10") + logs - n_far * rare + F.col("n_phrases") * math.log10(1 - REPEAT) + F.coalesce("gain", F.lit(0.0))
    return whole.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("near_tokens") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("near_base") + logs - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        total.alias("score"),
        (-total / math.log10(2) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
