"""Language-model scores by online logistic context mixing.

A text's tokens are its words, lower-cased, then one end. The model predicts their bytes (a word's
own and a space after it; the end is a line feed), bit by bit, from what stands before them:

* Hashed contexts give a prediction each, from their counts of zeros and ones in all training
  texts: the last two bytes; the last three; the word so far; and the word so far with
  the last frequent word before it, however far back that stands (it tells language and kind).
* A logistic mixer adds these in the logistic domain, with weights that a gate chooses by how
  often the last two contexts have been seen. Weights are learned online: bits are predicted with
  what was learned from those before them, then learned from, a position's own count left out.
* A last table, learned alike, maps the mixed probability, by gate, to how often such bits were ones.

Every probability depends on earlier bytes only, so a text's score is the log of a true
probability, and its bits per byte follow. Beside it stands a base score from word counts.

How it is spread. A position's bits depend on two things: its word and the frequent word before. So
the work is done once for each distinct pair of these, whose number grows much slower than the
texts. Pairs with their counts are a distributed table. It is cut into buckets by the words' first
bytes (two, and more where very many pairs share these), so that a bucket holds all that is to be counted for the
word-so-far contexts of its words: sorted, these counts are sums over runs of words, exact, and
grow with the input. The first bytes are predicted in the same way, from one bucket of beginnings;
its mixer and last table are where those of each bucket start, and these go on in the order of the
bucket's sorted words. A bucket is fixed by bytes that are already predicted, and by nothing of the cluster, so
the number of tasks changes no score. Contexts of the last bytes are finite in number and have tables of fixed size.

Texts then sum their pairs' scores: the most frequent words' are broadcast (HEAD words, which bounds
the broadcast and changes no result), the others' joined. Words over 31 bytes are predicted in
pieces of 32 bytes, texts are read in pieces of CHUNK bytes, so neither needs memory for its length.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, remainder, short_batches, written

#: Frequent words that contexts know, of so many bytes at most; classes: none of them yet, each, and that a piece of a long word came before.
FREQUENT, SHORT = 16, 4
CONTINUED, LONG = FREQUENT + 1, FREQUENT + 2
KINDS = LONG + 1
#: Bytes of a piece.
PIECE = 32
#: Words whose scores every task knows.
HEAD = 1 << 18
#: Words, and tokens, that a task counts before it passes the counts on; bytes that a task reads at once.
COUNTED, HELD, CHUNK = 300_000, 3_000_000, 1 << 22
#: Pairs of a bucket, about; pairs that may share a beginning before it is lengthened.
BUCKET, SHARED = 1 << 16, 1 << 17
#: Slots of the tables for two and three bytes; slots of a part in which they are merged.
SIZES = (1 << 22, 1 << 22)
SLICE = 1 << 16
#: Inputs of the mixer: two tables, two word contexts, bias. Rows of an online step.
INPUTS, STEP = 5, 1 << 13
_LEVELS, _STEPS = 6, 33
_GATES = _LEVELS * _LEVELS
_LEVEL = np.digitize(np.arange(202), (0.5, 1.5, 4.5, 20.5, 200.5))
#: Rounds over the beginnings; what a cell of their last table counts for in a bucket.
ROUNDS, PRIOR = 4, 64
#: Added to counts of zeros and ones.
SMALL = 0.02
END = b"\n"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_GAPS = b" \t\n\x0b\x0c\r"


def tokens(text: str) -> list[bytes]:
    """Words as bytes, A-Z lower-cased; they are separated by 0x20 and 0x09-0x0D."""
    return text.encode().translate(_LOWER).split()


def chunks(text: bytes | None) -> Iterator[bytes]:
    """A text's bytes, lower-cased, in pieces of about CHUNK that end where words do."""
    data = (text or b"").translate(_LOWER)
    first = 0
    while len(data) - first > CHUNK:
        last = first + CHUNK
        while last < len(data) and data[last] not in _GAPS:
            last += 1
        yield data[first:last]
        first = last
    yield data[first:]


def texts_of(column: pa.Array) -> Iterator[bytes | None]:
    """The column's texts as bytes, one at a time."""
    return (x.as_py() for x in column.cast(pa.large_binary()))


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of texts that are lower-cased already, and how many each has."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    words = pc.list_flatten(lists).cast(pa.large_binary())
    full = pc.binary_length(words).to_numpy() > 0  # white space at a text's ends leaves empty ones
    sizes = np.diff(np.r_[0, np.cumsum(full)][np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]])
    return words if full.all() else words.filter(pa.array(full)), sizes


def spell(key: bytes) -> bytes:
    """The bytes that are predicted for a key of ``Tokens``: a word's with a space; pieces, ends and digests are what they are."""
    if key == END or key[0] == 0xFF:
        return key
    return key[1:] if key[0] == 0x20 else key + b" "


def unspell(spelled: bytes) -> bytes:
    """The key that ``spell`` gives these bytes for, of a whole word, an end or a digest."""
    return spelled if spelled == END or spelled[0] == 0xFF else spelled[:-1]


def key_facts(spelled: list[bytes], known: np.ndarray) -> np.ndarray:
    """Of each key: whether it is a token, or (a piece) only a part of one; whether that is known; its part in
    the base score; the bytes that are predicted. ``known``: counts in training texts; -1: left to the join."""
    token = np.array([w[-1:] == b" " or w == END or w[0] == 0xFF for w in spelled], float)
    size = np.array([0 if w[0] == 0xFF else len(w) for w in spelled], float)
    base = np.where(known >= 0, np.log10(np.maximum(known, 0) + 0.1), 0)
    return np.stack([token, token * (known > 0), token * base, size], 1).reshape(-1, 4)


class Tokens:
    """The tokens of a lot of texts, as numbers of their own vocabulary, with the frequent word before each.

    Keys: words; a space and a piece of a long word; 0xFF and the digest of a long word (no word begins with these); the end.
    The known keys' numbers come first; ``known`` is many tasks' and large, so it is neither changed nor copied.
    """

    def __init__(self, frequent: dict[bytes, int], known: dict[bytes, int] | None = None):
        self.frequent, self.known = frequent, known or {}
        self.known_ranks = self._ranks(self.known)
        self.clear()

    def _ranks(self, keys: Iterable[bytes]) -> np.ndarray:
        return np.fromiter((self.frequent.get(k, 0) for k in keys), np.int32)

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ranks = self.known_ranks

    def number(self, key: bytes) -> int:
        found = self.known.get(key)
        return self.place.setdefault(key, len(self.known) + len(self.place)) if found is None else found

    def pieces(self, word: bytes) -> list[int]:
        """Numbers of a long word's pieces and of its digest."""
        spelled = word + b" "
        cut = [self.number(b" " + spelled[i : i + PIECE]) for i in range(0, len(spelled), PIECE)]
        return [*cut, self.number(b"\xff" + hashlib.sha256(word).digest())]

    def lot(self, pieces: list[tuple[int, bytes, bool]], before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(word, class, row) of all tokens of (row, bytes, whether the text ends here), and the class after them."""
        words, sizes = split_words([data for _, data, _ in pieces])
        encoded = words.dictionary_encode()
        number = self.number
        numbers = np.fromiter((number(w) if len(w) < PIECE else -1 for w in encoded.dictionary.to_pylist()), np.int32)
        word = numbers[encoded.indices.to_numpy()]
        row = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        continued = long = np.zeros(0, np.int64)
        at = np.flatnonzero(word < 0)
        if len(at):
            cut = [self.pieces(words[i].as_py()) for i in at.tolist()]
            many = np.ones(len(word), np.int64)
            many[at] = [len(c) for c in cut]
            ends = np.cumsum(many)[at]
            word, row = np.repeat(word, many), np.repeat(row, many)
            word[np.flatnonzero(word < 0)] = np.concatenate(cut)
            long = ends - 1
            continued = np.concatenate([np.arange(e - len(c) + 1, e - 1) for e, c in zip(ends.tolist(), cut, strict=True)])
        # An end behind the tokens of each text that ends here.
        ending = np.flatnonzero([e for _, _, e in pieces])
        put = np.searchsorted(row, ending, "right")
        word, row = np.insert(word, put, self.number(END)), np.insert(row, put, ending)
        continued, long = (x + np.searchsorted(put, x, "right") for x in (continued, long))
        of = np.array([r for r, _, _ in pieces], np.int64)
        if not len(word):
            return word, word, of[row], before
        new = self._ranks(islice(self.place, len(self.ranks) - len(self.known), None))
        if len(new):
            self.ranks = np.concatenate([self.ranks, new])
        del words, encoded, numbers
        at, none = np.arange(len(word), dtype=np.int32), np.int32(0)  # of four bytes, as all that is a number a token
        row = of[row]
        start = np.maximum.accumulate(np.where(np.r_[True, row[1:] != row[:-1]], at, none))
        rank = self.ranks[word]
        last = np.empty_like(at)
        last[0] = -1
        np.maximum.accumulate(np.where(rank > 0, at, np.int32(-1))[:-1], out=last[1:])
        kind = np.where(last >= start, rank[np.maximum(last, 0)], none)
        if before >= 0:  # the first row goes on from the lot before
            kind[(start == 0) & (last < 0)] = before
        after = int(rank[-1] or kind[-1])
        kind[continued], kind[long] = CONTINUED, LONG
        return word, kind, row, after


def _lots(batches: Iterator[pa.RecordBatch], tokens_: Tokens, number: int) -> Iterator[tuple]:
    """(batch's other columns by row, word, class, row) of texts in the first column, in lots of about CHUNK bytes."""
    held: list[tuple[int, bytes, bool]] = []
    others: dict[int, tuple] = {}
    size, before, row = 0, -1, number
    for batch in batches:
        for text, *other in zip(texts_of(batch.column(0)), *(c.to_pylist() for c in batch.columns[1:]), strict=True):
            row += 1
            parts = chunks(text)
            part = next(parts)
            while part is not None:
                following = next(parts, None)
                held.append((row, part, following is None))
                others[row] = tuple(other)
                size += len(part)
                if size >= CHUNK:
                    *found, before = tokens_.lot(held, before)
                    yield others, *found
                    if following is None:
                        before = -1
                    held, others, size = [], {}, 0
                part = following
    if held:
        yield others, *tokens_.lot(held, before)[:3]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): partial counts of words of up to SHORT bytes."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        words, _ = split_words([part for text in texts_of(batch.column(0)) for part in chunks(text)])
        few = words.filter(pc.less_equal(pc.binary_length(words), SHORT)).value_counts()
        counts.update(dict(zip(few.field("values").to_pylist(), few.field("counts").to_pylist(), strict=True)))
        if len(counts) > COUNTED:
            yield flush()
            counts = Counter()
    yield flush()


def _pairs(frequent: dict[bytes, int]):
    """(spelled, kind, n) of (text, learn): partial counts of pairs, n of them in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Tokens(frequent)
        held: list[np.ndarray] = []  # of each token, its pair's number and, in the lowest bit, whether it is learned from

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            key = np.concatenate(held)
            held.clear()
            key.sort()  # a table of all pairs that there could be would be many times as large
            starts = np.flatnonzero(np.r_[True, (key[1:] ^ key[:-1]) > 1])
            at = key[starts] >> 1
            key &= 1
            n = np.add.reduceat(key, starts, dtype=np.int64)
            del key
            words = pa.array((spell(k) for k in found.place), pa.binary())
            for i in range(0, len(at), 1 << 16):
                some = at[i : i + (1 << 16)]
                columns = [words.take(pa.array(some // KINDS)), pa.array((some % KINDS).astype(np.int32)), pa.array(n[i : i + (1 << 16)])]
                yield pa.RecordBatch.from_arrays(columns, ["spelled", "kind", "n"])
            found.clear()

        for others, word, kind, row in _lots(batches, found, -1):
            if len(word):
                first = int(row[0])
                learn = np.array([others.get(r, (False,))[0] for r in range(first, int(row[-1]) + 1)], bool)
                held.append((word * KINDS + kind) * 2 + learn[row - first])
            if len(found.place) > COUNTED or sum(map(len, held)) > HELD:
                yield from flush()
        yield from flush()

    return run


class Bucket:
    """Distinct (spelled word, class) pairs, sorted by both, with counts; bits of words from byte ``first`` on."""

    def __init__(self, spelled: list[bytes], kind: np.ndarray, n: np.ndarray, first: np.ndarray):
        new = np.array([True, *(a != b for a, b in zip(spelled, spelled[1:], strict=False))], bool)[: len(spelled)]
        self.of = np.cumsum(new) - 1
        self.starts = np.flatnonzero(new)
        words = [spelled[i] for i in self.starts]
        self.n = n.astype(np.float64)
        self.c = np.add.reduceat(self.n, self.starts) if len(words) else np.zeros(0)
        self.bytes = np.frombuffer(b"".join([w.ljust(PIECE, b"\0") for w in words]), np.uint8).reshape(-1, PIECE)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.first = first[self.starts] if len(words) else first
        self.alike = self._alike(self.bytes[:-1], self.bytes[1:])
        self.order = np.lexsort((self.of, kind))
        by = self.of[self.order]
        self.alike_kind = self._alike(self.bytes[by[:-1]], self.bytes[by[1:]])
        if len(by):
            self.alike_kind[1:][np.diff(kind[self.order]) != 0] = -1

    @staticmethod
    def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal leading bytes of each word and the one before it."""
        if not len(a):
            return np.full(1, -1)
        unlike = a != b
        return np.r_[-1, np.where(unlike.any(1), unlike.argmax(1), PIECE)]

    def depths(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each byte's number, and the words that have to be predicted there."""
        for d in range(int(self.sizes.max(initial=0))):
            active = np.flatnonzero((self.first <= d) & (d < self.sizes))
            if len(active):
                yield d, active

    def slots(self, d: int, active: np.ndarray) -> list[np.ndarray]:
        """Each table's slot before the node within the byte is added (spaces stand before a word)."""
        b1, b2, b3 = (self.bytes[active, d - k].astype(np.int64) if d >= k else np.full(len(active), 32) for k in (1, 2, 3))
        return [(b2 << 8 | b1) << 8, (b3 << 16 | b2 << 8 | b1) << 8]

    @staticmethod
    def slot(table: int, base: np.ndarray, node: np.ndarray) -> np.ndarray:
        key = (base + node).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (key >> np.uint64(42)).astype(np.int64) + sum(SIZES[:table])

    def count(self, counts: np.ndarray) -> None:
        """Adds all bits of all words to (zeros, ones) of the tables."""
        for d, active in self.depths():
            byte, c = self.bytes[active, d].astype(np.int64), self.c[active]
            seen = c > 0
            byte, c = byte[seen], c[seen].astype(np.float32)
            bases = [b[seen] for b in self.slots(d, active)]
            for j in range(8):
                node, bit = 1 << j | byte >> (8 - j), byte >> (7 - j) & 1
                for t, base in enumerate(bases):
                    np.add.at(counts, 2 * self.slot(t, base, node) + bit, c)

    @staticmethod
    def _runs(c: np.ndarray, bit: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each element's run has its bit, and the other."""
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(c)])
        every, ones = np.repeat(np.add.reduceat(c, starts), sizes), np.repeat(np.add.reduceat(c * bit, starts), sizes)
        same = np.where(bit, ones, every - ones)
        return same, every - same

    @staticmethod
    def _stretched(same: np.ndarray, other: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of ones to zeros, with and without the position's own count."""
        same, other = same.astype(np.float32), np.log(other.astype(np.float32) + np.float32(SMALL))
        return sign * (np.log(same + np.float32(SMALL)) - other), sign * (np.log(np.maximum(same - 1, 0) + np.float32(SMALL)) - other)

    @staticmethod
    def _level(n: np.ndarray) -> np.ndarray:
        return _LEVEL[np.clip(n, 0, len(_LEVEL) - 1).astype(np.int32)]

    def bits(self, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
        """(rows, bits, inputs, gates) of each bit's place; inputs and gates with the position's own count, and without."""
        pairs = counts.reshape(-1, 2)
        for d, active in self.depths():
            mark = np.full(len(self.sizes), -1)
            mark[active] = np.arange(len(active))
            rows = np.flatnonzero(mark[self.of] >= 0)
            up = mark[self.of[rows]]
            there = mark[self.of[self.order]]
            ranked = self.order[there >= 0]
            back = np.empty(len(self.of), np.int64)
            back[ranked] = np.arange(len(ranked))
            back = back[rows]
            byte = self.bytes[active, d].astype(np.int64)
            byte_kind = byte[there[there >= 0]]
            new, new_kind = self.alike[active] < d, self.alike_kind[there >= 0] < d
            new[0] = new_kind[0] = True
            bases, c, n = self.slots(d, active), self.c[active], self.n[ranked]
            x, alone = np.empty((INPUTS, len(rows)), np.float32), np.empty((INPUTS, len(rows)), np.float32)
            x[-1] = alone[-1] = 0.3
            for j in range(8):
                bit = byte >> (7 - j) & 1
                sign = (2 * bit - 1).astype(np.float32)
                node = 1 << j | byte >> (8 - j)
                for t, base in enumerate(bases):
                    seen = pairs[self.slot(t, base, node)]
                    own = bit == 1
                    with_, without = self._stretched(np.where(own, seen[:, 1], seen[:, 0]), np.where(own, seen[:, 0], seen[:, 1]), sign)
                    x[t], alone[t] = with_[up], without[up]
                same, other = self._runs(c, bit, new)
                with_, without = self._stretched(same, other, sign)
                x[2], alone[2] = with_[up], without[up]
                gate, gate_alone = self._level(same + other)[up] * _LEVELS, self._level(same + other - (same > 0))[up] * _LEVELS
                bit_kind = byte_kind >> (7 - j) & 1
                same, other = self._runs(n, bit_kind, new_kind)
                with_, without = self._stretched(same, other, (2 * bit_kind - 1).astype(np.float32))
                x[3], alone[3] = with_[back], without[back]
                gate += self._level(same + other)[back]
                gate_alone += self._level(same + other - (same > 0))[back]
                yield rows, bit[up], (x, alone), (gate, gate_alone)
                new[1:] |= bit[1:] != bit[:-1]
                new_kind[1:] |= bit_kind[1:] != bit_kind[:-1]


class Mixer:
    """Weights: a row of INPUTS for each gate. Last table: ones and bits seen. Both are learned online."""

    def __init__(self):
        self.weights = np.full((_GATES, INPUTS), 0.2, np.float32)
        self.weights[:, -1] = 0
        self.last = np.zeros((_GATES * _STEPS, 2))
        self.steps = np.zeros(_GATES)

    def begun(self) -> Mixer:
        """Where another bucket starts: these weights, and the last table as if seen PRIOR times at most."""
        new = Mixer()
        new.weights = self.weights.copy()
        new.last = self.last * np.minimum(1, PRIOR / np.maximum(self.last[:, 1:], 1e-9))
        new.steps = np.minimum(self.steps, 30)
        return new

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ki,ik->i", x, self.weights[gate]), -12, 12)

    @staticmethod
    def step(dot: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return gate * _STEPS + np.rint((dot + 12) * ((_STEPS - 1) / 24)).astype(np.int64)

    def run(self, bucket: Bucket, counts: np.ndarray) -> np.ndarray:
        """log10 of each pair's probability, given the bytes before ``first``; learns from each bit's places after it.

        A pair is learned from as often as it occurs in training texts, each occurrence without its own count.
        """
        total = np.zeros(len(bucket.of))
        for rows, bits, (x, alone), (gates, gates_alone) in bucket.bits(counts):
            # All of a bit's places are scored with the same weights, so that zeros and ones sum to one.
            # The mean of the mixed probability p and the table's, (ones + 16 p) / (seen + 16), as a line in p.
            by = 1 / (self.last[:, 1] + 16)
            slope, offset = (0.5 + 8 * by).astype(np.float32), (self.last[:, 0] * by / 2).astype(np.float32)
            dot = self.mixed(x, gates)
            step = self.step(dot, gates)
            p = np.clip(slope[step] / (1 + np.exp(-dot)) + offset[step], np.float32(1e-6), np.float32(1 - 1e-6))
            total[rows] += np.log10(np.where(bits == 1, p, 1 - p))
            weight = bucket.n[rows]
            for i in range(0, len(rows), STEP):
                part = slice(i, i + STEP)
                near, gate, bit, w = alone[:, part], gates_alone[part], bits[part], weight[part]
                dot = self.mixed(near, gate)
                step = self.step(dot, gate)
                self.last[:, 0] += np.bincount(step, w * bit, len(self.last))
                self.last[:, 1] += np.bincount(step, w, len(self.last))
                error = (bit - 1 / (1 + np.exp(-dot))) * w
                many = np.bincount(gate, w, _GATES)
                rate = (0.02 + 0.4 / (1 + self.steps / 30)) / np.maximum(many, 1e-9)
                for k in range(INPUTS):
                    self.weights[:, k] += rate * np.bincount(gate, error * near[k], _GATES)
                self.steps += many > 0
        return total


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole buckets of (bucket, begins, spelled, kind, n), which come sorted by bucket, word and class."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[int, list, np.ndarray, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        return t["bucket"][0].as_py(), t["spelled"].to_pylist(), *(t[c].to_numpy() for c in ("kind", "n", "begins"))

    for batch in batches:
        of = batch.column("bucket").to_numpy()
        ends = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for i, j in zip(ends, ends[1:], strict=False):
            if i == j:
                continue
            if held and held[-1].column("bucket")[0].as_py() != int(of[i]):
                yield whole()
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield whole()


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, at, zeros and ones): what this task's words add to the tables, the slots that aren't zero only."""
    counts = np.zeros(2 * sum(SIZES), np.float32)
    for _, spelled, kind, n, _first in _buckets(batches):
        Bucket(spelled, kind, n, np.zeros(len(n), np.int64)).count(counts)
    for i in range(0, len(counts), 2 * SLICE):
        part = counts[i : i + 2 * SLICE]
        at = np.flatnonzero(part)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([i // (2 * SLICE)], pa.int64()), pa.array([at.astype(np.int32).tobytes()]), pa.array([part[at].tobytes()])], ["part", "at", "counts"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal parts, as half floats; a pair too large for these keeps its ratio."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, at, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if i not in total:
                total[i] = np.zeros(2 * SLICE)
            total[i][np.frombuffer(at, np.int32)] += np.frombuffer(counts, np.float32)
    for i, c in total.items():
        pairs = c.reshape(-1, 2)
        pairs *= np.minimum(1, 60_000 / np.maximum(pairs.max(1, keepdims=True), 1))
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([pairs.astype(np.float16).tobytes()])], ["part", "counts"])


def _scored(counts, begun):
    """(spelled, kind, score, known): each pair's log10 probability, and its word's count in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, mixer = begun.value
        for _, spelled, kind, n, first in _buckets(batches):
            bucket = Bucket(spelled, kind, n, first)
            score = mixer.begun().run(bucket, counts.value)
            score += [start[s[:f], k] for s, f, k in zip(spelled, first.tolist(), kind.tolist(), strict=True)]
            word = np.where(kind == CONTINUED, 0, n)
            known = np.add.reduceat(word, bucket.starts)[bucket.of]
            out = [pa.array(spelled, pa.binary()), pa.array(kind.astype(np.int32)), pa.array(score.astype(np.float32)), pa.array(known)]
            for i in range(0, len(n), 1 << 16):
                yield pa.RecordBatch.from_arrays([c.slice(i, 1 << 16) for c in out], ["spelled", "kind", "score", "known"])

    return run


def _documents(frequent: dict[bytes, int], head):
    """(row, doc_id, n_tokens, n_known, base, score, bytes) of each lot of a text, and its other pairs, counted, for the join."""
    names = ["row", "doc_id", "n_tokens", "n_known", "base", "score", "bytes", "rest"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, first_facts, scores_ = head.value  # the head's words are the first of all keys
        found = Tokens(frequent, place)
        for others, word, kind, row in _lots(batches, found, TaskContext.get().partitionId() << 33):
            new = [spell(k) for k in found.place]
            facts = np.concatenate([first_facts, key_facts(new, np.full(len(new), -1))])
            found.clear()  # words that aren't the head's are rare, so few come again
            first = min(others)
            r, many = row - first, max(others) - first + 1
            sums, score = np.zeros((many, 4)), np.zeros(many)
            if len(word):
                part = kind == CONTINUED
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                for i in range(4):
                    each = facts[word, i]
                    if i < 3:  # the last piece of a long word is no token
                        each[part] = 0
                    sums[r[starts], i] = np.add.reduceat(each, starts)
                score[r[starts]] = np.add.reduceat(scores_[np.minimum(word, len(place)) * KINDS + kind].astype(float), starts)
            values = [sums[:, 0], sums[:, 1], sums[:, 2], score, sums[:, 3]]
            # The other pairs, counted by text.
            other = np.flatnonzero(word >= len(place))
            width = max(len(new), 1)
            key, n = np.unique((r[other] * width + (word[other] - len(place))) * KINDS + kind[other], return_counts=True)
            ends = np.searchsorted(key // (KINDS * width), np.arange(many + 1))
            words = np.array([*new, b""], object)[key // KINDS % width]
            rest = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array((key % KINDS).astype(np.int32)), pa.array(n)], ["spelled", "kind", "k"])
            ids = [others[i + first][0] if i + first in others else None for i in range(many)]
            columns = [np.arange(many) + first, ids, *values]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)
            yield pa.RecordBatch.from_arrays([*(pa.array(list(v), k) if isinstance(v, list) else pa.array(v).cast(k, safe=False) for v, k in zip(columns, kinds, strict=True)), lists], names)

    return run


def beginnings(pairs: DataFrame) -> tuple[list[tuple[bytes, int, int]], DataFrame]:
    """The words' beginnings (begin, kind, n) that no other of them begins with, and the pairs with theirs.

    Two bytes, and one more as long as more than SHARED pairs share one. To the driver come at most 65,536
    beginnings, and 256 for each SHARED pairs and byte, by class.
    """
    size, leaves, open_ = 2, [], None
    begins = F.substring("spelled", 1, 2)
    while True:
        shorter = F.substring("spelled", 1, size - 1)
        some = pairs if open_ is None else pairs.filter(shorter.isin(open_))
        begin = F.substring("spelled", 1, size)
        level = some.groupBy(begin.alias("begin"), "kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs")).toArrow()
        rows = list(zip(*(c.to_pylist() for c in level.columns), strict=True))
        shared = Counter()
        for b, _, _, many in rows:
            shared[b] += many
        open_ = [b for b, many in shared.items() if many > SHARED and len(b) == size]
        closed = set(open_)
        leaves += [(b, kind, n) for b, kind, n, _ in rows if b not in closed]
        if not open_ or size == PIECE:
            return sorted(leaves), pairs.withColumn("begin", begins)
        begins = F.when(begin.isin(open_), F.substring("spelled", 1, size + 1)).otherwise(begins)
        size += 1


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), a row for each row of ``docs``.

    Learns from the texts whose crc32(doc_id) modulo 10 is not 0; rows without a doc_id are held out.
    A null text counts as empty: its one token is the end. Repeated rows count, and are scored, each.
    Without training texts base_score is that of unknown tokens, and score that of the untrained
    mixer. An empty table gives an empty one. bits_per_byte counts the bytes that are predicted.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    short_batches(spark)
    learn = F.coalesce(remainder(F.col("doc_id"), 10) != 0, F.lit(False)).alias("learn")
    words = docs.filter(learn).select("text").mapInArrow(lean(_words), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = words.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    frequent = {bytes(r.word): i + 1 for i, r in enumerate(top)}

    counted = docs.select("text", learn).mapInArrow(lean(_pairs(frequent)), "spelled binary, kind int, n long")
    every = written(counted.groupBy("spelled", "kind").agg(F.sum("n").alias("n")), "pairs")
    pairs = every.filter(F.col("kind") != LONG)
    leaves, begun = beginnings(pairs)
    total = max(1, pairs.count() // BUCKET)
    bucketed = begun.select(F.pmod(F.xxhash64("begin"), F.lit(total)).cast("int").alias("bucket"), F.length("begin").cast("long").alias("begins"), "spelled", "kind", "n")
    # A bucket is in one file, and far smaller than a row group, so each is read by one task, in this order.
    sorted_ = written(bucketed.repartitionByRange(max(8, total), "bucket").sortWithinPartitions("bucket", "spelled", "kind"), "buckets")

    sliced = sorted_.mapInArrow(lean(_tables), "part long, at binary, counts binary")
    merged = sliced.repartition(8, "part").mapInArrow(lean(_merged), "part long, counts binary")
    tables = np.zeros(2 * sum(SIZES), np.float16)
    for r in merged.collect():  # SIZES bound it
        tables[r.part * 2 * SLICE : (r.part + 1) * 2 * SLICE] = np.frombuffer(r.counts, np.float16)
    first = Bucket([b for b, _, _ in leaves], np.array([k for _, k, _ in leaves]), np.array([n for _, _, n in leaves]), np.zeros(len(leaves), np.int64))
    mixer = Mixer()
    for _ in range(ROUNDS):
        score = mixer.run(first, tables)
    start = {(b, k): s for (b, k, _), s in zip(leaves, score.tolist(), strict=True)}
    spelled = sorted_.mapInArrow(lean(_scored(sc.broadcast(tables), sc.broadcast((start, mixer)))), "spelled binary, kind int, score float, known long")
    long = every.filter(F.col("kind") == LONG).select("spelled", "kind", F.lit(0.0).cast("float").alias("score"), F.col("n").alias("known"))
    scored = written(spelled.unionByName(long), "spelled")
    token = F.substring("spelled", -1, 1).isin(b" ", END) & (F.col("kind") != CONTINUED) | (F.col("kind") == LONG)
    by_word = written(scored.filter(token).groupBy("spelled").agg(F.max("known").alias("known")), "words")
    facts = by_word.agg(F.coalesce(F.sum("known"), F.lit(0)).alias("n"), F.count_if(F.col("known") > 0).alias("types")).first()

    chosen = by_word.orderBy(F.desc("known"), "spelled").limit(HEAD)
    listed = scored.select("spelled", "kind", "score").join(F.broadcast(chosen), "spelled").groupBy("spelled")
    rows = listed.agg(F.max("known").alias("known"), F.collect_list("kind").alias("kinds"), F.collect_list("score").alias("scores")).toArrow()  # HEAD rows, KINDS scores each at most
    words_of = rows["spelled"].to_pylist()
    place = {unspell(w): i for i, w in enumerate(words_of)}
    table = np.zeros((len(words_of) + 1, KINDS), np.float32)
    at = np.repeat(np.arange(len(words_of)), pc.list_value_length(rows["kinds"]).to_numpy())
    table[at, pc.list_flatten(rows["kinds"]).to_numpy()] = pc.list_flatten(rows["scores"]).to_numpy()
    head = sc.broadcast((place, key_facts(words_of, rows["known"].to_numpy()), table.ravel()))

    schema = "row long, doc_id long, n_tokens long, n_known long, base double, score double, bytes long, rest array<struct<spelled: binary, kind: int, k: long>>"
    texts = written(docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(lean(_documents(frequent, head)), schema), "texts")
    rest = texts.select("row", "doc_id", F.explode("rest").alias("x")).select("row", "doc_id", "x.*").join(scored, ["spelled", "kind"])
    some = F.when(token, F.col("k")).otherwise(0)
    zero = F.lit(0).cast("long")
    joined = rest.select(
        "row", "doc_id", zero.alias("n_tokens"), F.when(F.col("known") > 0, some).otherwise(0).alias("n_known"),
        (some * F.log10(F.col("known") + 0.1)).alias("base"), (F.col("k") * F.col("score").cast("double")).alias("score"), zero.alias("bytes"),
    )
    sums = texts.drop("rest").unionByName(joined).groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score", "bytes")))
    n, types = int(facts.n), int(facts.types)
    return sums.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 10) == 0, F.lit(True)).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(math.log10(n + 0.1 * (types + 1)))).alias("base_score"), "score",
        (-F.col("score") * F.log2(F.lit(10.0)) / F.col("bytes")).alias("bits_per_byte"),
    )
