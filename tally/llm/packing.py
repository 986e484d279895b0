"""Best-fit packing of documents into sequences by the linear grouping scheme.

Lengths are whole numbers up to the capacity, so a histogram of at most ``capacity``
entries describes any corpus, and the plan is made from it on the driver:

1. Large lengths are sorted and cut into groups of equal cardinality; each is
   rounded up to its group's largest.
2. The few rounded sizes are packed by configurations: the linear programme over all ways
   to fill a sequence, solved by column generation, rounded down.
3. Actual lengths take the slots of their group, which leaves the sequences some room.
4. What rounding left over, and all small lengths, go best-fit, longest first.

Equal sequences are handled at once, so the work depends on the capacity, not on the
corpus. The plan is a list of intervals: "of the pieces of this length, those ranked from
here to there go to these sequences at this offset". Ranks come from counts by
(length, bucket), so a length that a third of all pieces have is not one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, written
from .tokens import byte_bpe

#: Groups, and the share of the capacity above which lengths are large. All are tried on the
#: histogram, and the plan with the fewest sequences is taken.
SCHEMES = ((24, 1 / 2), (8, 1 / 4), (24, 1 / 4))


def _columns(sizes: list[int], need: list[int], capacity: int) -> list[tuple[tuple[int, ...], float]]:
    """Configurations (how many of each size) and how often the linear programme uses them."""
    g = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    demand = np.array(need, float)
    for _ in range(60 * g):
        dual = np.linalg.solve(basis.T, np.ones(g))
        # Unbounded knapsack by dynamic programming: the best configuration at these prices.
        value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(min(sizes), capacity + 1):
            best, which = value[room - 1], -1
            for i, s in enumerate(sizes):
                if s <= room and value[room - s] + dual[i] > best + 1e-12:
                    best, which = value[room - s] + dual[i], i
            value[room], last[room] = best, which
        if value[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(g), capacity
        while room > 0:
            if last[room] < 0:
                room -= 1
            else:
                column[last[room]] += 1
                room -= sizes[last[room]]
        now, move = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(move > 1e-9, now / np.where(move > 1e-9, move, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    often = np.maximum(np.linalg.solve(basis, demand), 0)
    return [(tuple(int(x) for x in basis[:, i]), float(often[i])) for i in range(g)]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Kinds of sequences: (((length, how many), ...), how many such sequences), for lengths of 1 to ``capacity``."""
    return min((_planned(histogram, capacity, *s) for s in SCHEMES), key=lambda kinds: sum(count for _, count in kinds))


def _planned(histogram: dict[int, int], capacity: int, groups_wanted: int, share: float) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    left = {n: c for n, c in histogram.items() if c > 0}
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room: contents and count
    large = sorted((n for n in left if n > capacity * share), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        each = -(-total // groups_wanted)
        groups: list[list[list[int]]] = []  # of [length, count]
        space = 0
        for n in large:
            c = left[n]
            while c:
                if space == 0:
                    groups.append([])
                    space = each
                take = min(c, space)
                groups[-1].append([n, take])
                c, space = c - take, space - take
        merged: dict[int, list[list[int]]] = defaultdict(list)  # groups that round up to the same size are one
        for group in groups:
            merged[group[0][0]] += group
        sizes = sorted(merged, reverse=True)
        need = [sum(c for _, c in merged[s]) for s in sizes]
        for column, often in sorted(_columns(sizes, need, capacity), key=lambda x: -x[1]):
            kinds: list[tuple[tuple[int, ...], int]] = [((), int(often + 1e-6))]
            for s, times in zip(sizes, column, strict=True):
                for _ in range(times):
                    kinds = [x for kind in kinds for x in _slot(kind, merged[s], left)]
            for contents, count in kinds:
                if contents:
                    open_[capacity - sum(contents)].append((contents, count))
    rooms = np.zeros(capacity + 1, bool)
    rooms[[r for r, k in open_.items() if k]] = True
    for n in sorted(left, reverse=True):
        while left[n]:
            fit = np.flatnonzero(rooms[n:])
            if len(fit):
                room = n + int(fit[0])
                contents, count = open_[room].pop()
                if not open_[room]:
                    rooms[room] = False
            else:
                room, contents, count = capacity, (), -(-left[n] // (capacity // n))
            # As many of this length as go in, in as many of these sequences as there are pieces for.
            times = min(room // n, -(-left[n] // count))
            full = min(count, left[n] // times)
            if full < count:
                open_[room].append((contents, count - full)) if contents else None
                rooms[room] = bool(open_[room])
            if full:
                open_[room - times * n].append((contents + (n,) * times, full))
                rooms[room - times * n] = True
                left[n] -= times * full
    out = []
    for kinds in open_.values():
        for contents, count in kinds:
            sizes_of: dict[int, int] = defaultdict(int)
            for n in contents:
                sizes_of[n] += 1
            out.append((tuple(sizes_of.items()), count))
    return out


def _slot(kind: tuple[tuple[int, ...], int], group: list[list[int]], left: dict[int, int]) -> Iterator[tuple[tuple[int, ...], int]]:
    """Gives one more slot of each of these sequences to actual lengths of the group, longest first."""
    contents, count = kind
    while count and group:
        n, c = group[0]
        take = min(c, count)
        group[0][1] -= take
        left[n] -= take
        if not group[0][1]:
            group.pop(0)
        yield (*contents, n), take
        count -= take
    if count:
        yield contents, count


def _cut(path: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        stop = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = bpe.encode(text or "") + stop
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    size = n - start if n - start <= capacity else (n - start) % capacity or capacity
                    part = ids[4 * start : 4 * (start + size)]
                    rows.append((doc_id, piece, start, size, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None))
                    start, piece = start + size, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[: 5 + with_ids])], names[: 5 + with_ids])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), a row for each piece of a document.

    ``docs``: doc_id, text; ``tokenizer``: the vocabulary file; ``end``: the id after each document;
    ``with_ids``: also the pieces' ids. Only documents of over ``capacity`` ids are cut; the first piece is
    the shorter one.

    A null or empty text is the end id alone. Rows that repeat a doc_id, or have none, are packed each
    by itself. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    short_batches(spark)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(tokenizer, capacity, end, with_ids), schema)
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = written(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))), "pieces")

    counts = written(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows: list[tuple[int, int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    first = 0
    for contents, count in plan(histogram, capacity):
        at = 0
        for n, times in contents:
            rows.append((n, used[n], used[n] + times * count, first, times, at))
            used[n] += times * count
            at += n * times
        first += count
    if dict(used) != histogram:
        raise AssertionError("the plan must hold every piece once")
    # Bounded by the plan, which depends on the capacity only.
    places = F.broadcast(spark.createDataFrame(rows, "length long, low long, high long, first long, times long, at long"))

    before = counts.withColumn("before", F.expr("sum(n) over (partition by length order by bucket) - n")).drop("n")
    ranked = pieces.withColumn("nth", F.expr("row_number() over (partition by length, bucket order by doc_id, piece, start, ids_crc32)"))
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    put = ranked.join(places, "length").filter("rank >= low and rank < high")
    return put.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("first + (rank - low) div times").alias("sequence_id"),
        F.expr("at + (rank - low) % times * length").alias("offset"),
        *["ids"] * with_ids,
    )
