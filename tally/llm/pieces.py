"""SentencePiece encoding that keeps source offsets, and decoding.

Normalisation matches, at each place of the source, the longest prefix in the model's
compiled character map (a double-array trie and its replacement strings), and records for
each normalised character which source bytes it came from. Pieces of the normalised text are
projected through that record to byte spans of the original.

Pieces are merged by score as byte-pair encoding does. No piece of a vocabulary reaches
from another character into a space mark, so words are encoded one by one. Where the model maps
no characters and drops no spaces, a text's words can be cut before they are normalised; each
distinct word is then normalised, encoded, projected to its span and decoded once, and remembered.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

SPACE = "▁"
#: Characters of the words that a Python worker remembers (it starts anew then), and of the longest one.
REMEMBERED, LONGEST = 8_000_000, 256
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(body: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message: (number, int | 4 or 8 bytes | bytes)."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = body[at]
            value |= (b & 127) << shift
            at += 1
            if b < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(body):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            n, at = varint(at)
            value, at = body[at : at + n], at + n
        else:
            n = 8 if tag & 7 == 1 else 4
            value, at = body[at : at + n], at + n
        yield tag >> 3, value


class CharacterMap:
    """Longest-prefix lookup in a compiled character map: size of the trie, its units, replacements ended by zero bytes."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """Bytes matched at ``at`` and what they become."""
        if not self.units:
            return None
        units = self.units
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        node, best = offset(units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        text = self.texts[best[1] : self.texts.index(b"\0", best[1])]
        return best[0], text.decode()


class PieceModel:
    """A byte-pair model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            body = f.read()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.texts: list[str] = []
        self.kinds: list[int] = []
        self.bytes: dict[int, int] = {}
        user = []
        self.unknown, self.unknown_text = 0, " ⁇ "
        specs: dict[int, dict] = {2: {}, 3: {}}
        for number, value in _fields(body):
            if number == 1:
                piece = dict(_fields(value))
                text, score, of = piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)
                here = len(self.texts)
                self.texts.append(text)
                self.kinds.append(of)
                if of in (NORMAL, USER, UNUSED):
                    self.ids[text], self.score[text] = here, score
                if of == USER:
                    user.append(text)
                if of == BYTE:
                    self.bytes[int(text[3:5], 16)] = here
                if of == UNKNOWN:
                    self.unknown = here
            elif number in specs:  # a message that comes twice is merged, as the format has it
                specs[number] |= dict(_fields(value))
        trained, rules = specs[2], specs[3]
        kind, fallback = trained.get(3, 1), bool(trained.get(35, 0))
        self.unknown_text = trained.get(44, self.unknown_text.encode()).decode()
        charsmap = rules.get(2, b"")
        self.add_prefix, self.drop_extra, self.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
        if kind != 2:
            raise ValueError("only byte-pair models are supported")
        if not fallback:
            self.bytes = {}
        self.map = CharacterMap(charsmap)
        self.user = re.compile("|".join(map(re.escape, sorted(user, key=len, reverse=True)))) if user else None
        inside = [t for t in self.ids if re.search(f"[^{SPACE}]{SPACE}", t)]
        lone_line = not any("\n" in t and len(t) > 1 for t in self.ids)
        self.cut = None if inside or user else re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if lone_line else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        #: What ids of ordinary pieces decode to.
        self.normal_texts = {i: t.replace(SPACE, " ") for i, t in enumerate(self.texts) if self.kinds[i] not in (BYTE, CONTROL, UNKNOWN)}
        plain = self.cut and not charsmap and not self.drop_extra and self.escape
        # The same cuts in the source, where a space isn't a mark yet.
        self.cut_source = re.compile(self.cut.pattern.replace(SPACE, f" {SPACE}").replace(f" {SPACE}*", f"[ {SPACE}]*").replace(f" {SPACE}+", f"[ {SPACE}]+")) if plain else None
        self.known: dict[str, str] = {}
        self.odd: set[str] = set()
        self.odd_parts: dict[str, tuple[int, str, str, int]] = {}
        self.remembered = 0

    def normalised(self, text: str, first: bool = True) -> tuple[str, list[int]]:
        """The normalised text, and for each of its characters and its end the source byte it starts at.

        ``first``: it begins a text, so a dummy prefix is added.
        """
        data = text.encode()
        out: list[str] = []
        source: list[int] = []
        at = 0
        if not self.map.units and not self.user:  # no prefix is longer than none: characters stay
            out = list(text)
            source = list(range(len(out))) if len(out) == len(data) else list(accumulate([len(c.encode()) for c in out], initial=0))[:-1]
            at = len(data)
        while at < len(data):
            found = self.map.longest(data, at)
            user = self.user.match(data[at:].decode()) if self.user else None
            if user:
                n, new = len(user[0].encode()), user[0]
            elif found:
                n, new = found
            else:
                n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                new = data[at : at + n].decode()
            out += new
            source += [at] * len(new)
            at += n
        if self.drop_extra:
            keep = [i for i, c in enumerate(out) if c != " " or (i and out[i - 1] != " ")]
            while keep and out[keep[-1]] == " ":
                keep.pop()
            end = source[keep[-1] + 1] if keep and keep[-1] + 1 < len(source) else at
            out, source = [out[i] for i in keep], [source[i] for i in keep]
        else:
            end = at
        if self.add_prefix and first and out:
            out.insert(0, " ")
            source.insert(0, source[0])
        joined = "".join(out)
        return joined.replace(" ", SPACE) if self.escape else joined, [*source, end]

    def merged(self, word: str) -> list[str]:
        """Merges of neighbours, best score first and leftmost first, until no pair is a piece."""
        parts = []
        at = 0
        for m in self.user.finditer(word) if self.user else ():
            parts += word[at : m.start()]
            parts.append(m[0])
            at = m.end()
        parts += word[at:]
        score = self.score
        if len(parts) > 64:
            return self._long(parts)
        low = float("-inf")
        pairs = [score.get(a + b, low) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = max(pairs)
            if best == low:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score.get(parts[i - 1] + parts[i], low)
            if i < len(pairs):
                pairs[i] = score.get(parts[i] + parts[i + 1], low)
        return parts

    def _long(self, parts: list[str]) -> list[str]:
        """The same with a heap and linked neighbours, for runs without a space."""
        import heapq

        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[float, int, str, str]] = []

        def push(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i], parts[j]))

        for i in range(n):
            push(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i])
            push(i)
        return [p for p in parts if p]

    def pieces(self, word: str) -> tuple[list[int], list[int]]:
        """Ids of a word's pieces, and each one's normalised characters (bytes of one character: the last has it)."""
        ids: list[int] = []
        sizes: list[int] = []
        for p in self.merged(word):
            i = self.ids.get(p)
            if i is not None and self.kinds[i] != UNUSED:
                ids.append(i)
                sizes.append(len(p))
            elif self.bytes:
                raw = p.encode()
                ids += [self.bytes[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(p)]
            else:
                ids.append(self.unknown)
                sizes.append(len(p))
        return ids, sizes

    def encode(self, text: str, first: bool = True) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and the source byte span of each. The bytes of one character share its span; a dummy prefix adds nothing."""
        normal, source = self.normalised(text, first)
        ids: list[int] = []
        spans: list[tuple[int, int]] = []
        at = 0
        for cut in self.cut.findall(normal) if self.cut else [normal]:
            of, sizes = self.pieces(cut)
            ids += of
            start = at
            waiting = 0
            for n in sizes:
                if n == 0:
                    waiting += 1
                    continue
                spans += [(source[start], source[start + n])] * (waiting + 1)
                waiting, start = 0, start + n
            at = start
        return ids, spans

    def part(self, text: str, first: bool) -> tuple[int, str, str, int]:
        """A part's number of ids, the ids as text, the text that they decode to, and the source bytes that their spans cover."""
        ids, spans = self.encode(text, first)
        return len(ids), ",".join(map(str, ids)), self.decode(ids, first), covered(spans)

    def digest(self, text: str) -> tuple[int, str, str, int]:
        """Number of ids, digests of the ids and of the decoded text, and the source bytes covered, part by part."""
        if not text:
            return 0, _sha(""), _sha(""), 0
        if not self.cut_source:
            count, ids, decoded, covers = self.part(text, True)
            return count, _sha(ids), _sha(decoded), covers
        if self.remembered > REMEMBERED:
            for kept in (self.known, self.odd, self.odd_parts):
                kept.clear()
            self.remembered = 0
        parts = self.cut_source.findall(text)
        found = list(map(self.known.get, parts))
        for i, part in enumerate(parts) if None in found else ():
            if found[i] is None:
                found[i] = self.known.get(part) or self.remember(part)
        first = self.part(parts[0], True)
        found[0] = first[1]
        found = [f for f in found if f] if "" in found else found
        ids = ",".join(found)
        rest = parts[1:]
        if self.odd.isdisjoint(rest):
            # Each of these parts was found to decode to itself, and its spans to cover it.
            tail = text[len(parts[0]) :]
            return ids.count(",") + bool(ids), _sha(ids), _sha(first[2] + tail), first[3] + len(tail.encode())
        each = [self.odd_parts.get(p) or (0, "", p, len(p.encode())) for p in rest]
        return ids.count(",") + bool(ids), _sha(ids), _sha(first[2] + "".join([x[2] for x in each])), first[3] + sum([x[3] for x in each])

    def remember(self, part: str) -> str:
        """A part's ids as text. Kept, if it isn't too long; so is what it decodes to and covers, if that isn't the part itself."""
        found = self.part(part, False)
        self.remembered += len(part)
        if found[2] != part or found[3] != len(part.encode()):
            self.odd.add(part)
            self.odd_parts[part] = found
        if len(part) <= LONGEST:
            self.known[part] = found[1]
        return found[1]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids: space marks to spaces, byte pieces to characters (U+FFFD for what isn't UTF-8).

        ``first``: the ids begin a text, so a dummy prefix is dropped.
        """
        plain = [self.normal_texts.get(i) for i in ids]
        if None not in plain and not (first and self.add_prefix):
            return "".join(plain)
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + n].decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            kind, text = self.kinds[i], self.texts[i]
            if kind == BYTE:
                run.append(int(text[3:5], 16))
                first = False
                continue
            flush()
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(self.unknown_text)
            else:
                if first and self.add_prefix and text.startswith(SPACE):
                    text = text[1:]
                out.append(text.replace(SPACE, " "))
            first = False
        flush()
        return "".join(out)


def covered(spans: list[tuple[int, int]]) -> int:
    """Bytes in the union of spans, which come by their starts."""
    total = reach = 0
    for a, b in spans:
        if b > reach:
            total += b - (a if a > reach else reach)
            reach = b
    return total


_LOADED: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            rows = [model.digest(text or "") for text in batch.column(1).to_pylist()]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    return run


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes), a row for each row of ``docs`` (doc_id, text).

    covered_bytes: the source bytes in the union of the pieces' spans. A null text counts as empty: no ids,
    and the digests of the empty string. Repeated rows and null ids stay as they are.
    """
    short_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digests(model), schema)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, starts, ends): every piece with its span of source bytes. Null texts have empty lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in batches:
            found = [pieces.encode(t or "") for t in batch.column(1).to_pylist()]
            lists = [[f[0] for f in found], [[s for s, _ in f[1]] for f in found], [[e for _, e in f[1]] for f in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in lists)], ["doc_id", "ids", "starts", "ends"])

    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of ``encoded`` (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in batches:
            texts = [pieces.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    short_batches(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
