"""Exact top-k search by inner product over norm-sorted blocks.

Vectors are scaled to integers, sorted by length into blocks, and rotated by the
eigenvectors of their Gram matrix (the right singular vectors), so that few leading
coordinates hold most of an inner product. Queries are blocks, too. The block of the
longest vectors gives each query a first threshold.

Candidate blocks are dealt to shards, query blocks to groups; a task gets one shard and one
group. It takes the shard's blocks in order of length. A query's threshold is its k-th best score so far, and
rises; the search ends when the longest candidate left can't reach any threshold.
In a block the Cauchy-Schwarz bound ``leading part + |rest of query| * |rest of candidate|``
leaves a few pairs, which are scored exactly, in integers. Only a query's k best of
a shard leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches, written

#: Bytes of a block's vectors, as 64-bit integers.
BLOCK = 1 << 19
#: Share of the squared length that the leading coordinates hold on average.
LEADING = 0.75
#: Candidate blocks of a shard, and query blocks of a group: what one task holds of the first, and reads of the second.
SHARD, GROUP = 64, 16


def _usable(v: Column) -> Column:
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _blocks(dims: int):
    """Packs rows (id, vector) in the order they come: (block, top, ids, vectors)."""
    size = max(1, BLOCK // (8 * max(dims, 1)))

    def pack(ids: list, vectors: list, block: int) -> pa.RecordBatch:
        m = np.zeros((len(ids), max(dims, 1)), np.int64)
        for i, v in enumerate(vectors):
            m[i, : len(v)] = v
        top = float(np.sqrt((m.astype(float) ** 2).sum(1)).max())
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([top]), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([m.tobytes()])], ["block", "top", "ids", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors = TaskContext.get().partitionId() << 32, [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            vectors += batch.column(1).to_pylist()
            while len(ids) >= size:
                yield pack(ids[:size], vectors[:size], at)
                ids, vectors, at = ids[size:], vectors[size:], at + 1
        if ids:
            yield pack(ids, vectors, at)

    return run


def _gram(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for body in batch.column(0).to_pylist():
                m = np.frombuffer(body, np.int64).reshape(-1, dims).astype(float)
                total += m.T @ m
        i, j = np.indices((dims, dims))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "s"])

    return run


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; floating point where that is exact."""
    if np.sqrt((q.astype(float) ** 2).sum(1).max() * (c.astype(float) ** 2).sum(1).max()) < 2**52:
        return np.rint(q.astype(float) @ c.astype(float).T).astype(np.int64)
    return q @ c.T


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        place = np.flatnonzero(score >= least)
        return place[np.lexsort((ids[place], -score[place]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _thresholds(longest: bytes, longest_ids: bytes, dims: int, k: int):
    """Adds each query's k-th best score in the block of the longest vectors, and what a candidate must be as long as."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, c_ids = np.frombuffer(longest, np.int64).reshape(-1, dims), np.frombuffer(longest_ids, np.int64)
        for batch in batches:
            least, need = [], []
            for ids, body in zip(batch.column("ids").to_pylist(), batch.column("vectors").to_pylist(), strict=True):
                q, q_ids = np.frombuffer(body, np.int64).reshape(-1, dims), np.frombuffer(ids, np.int64)
                score = _exact(q, c)
                floor = np.full(len(q), -np.inf)
                for i in range(len(q)):
                    own = score[i][c_ids != q_ids[i]]
                    if len(own) >= k:
                        floor[i] = np.partition(own, len(own) - k)[len(own) - k]
                length = np.sqrt((q.astype(float) ** 2).sum(1))
                least.append(floor.tobytes())
                need.append(float(np.where(length > 0, floor / np.maximum(length, 1e-300), np.where(floor > 0, np.inf, -np.inf)).min()))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("ids"), batch.column("vectors"), pa.array(least), pa.array(need)], ["q_block", "q_ids", "q_vectors", "least", "need"])

    return run


class _Block:
    """A block's vectors, what they are in the rotated axes, and lengths of the whole and of the part behind the leading axes."""

    def __init__(self, ids: bytes, body: bytes, turn: np.ndarray, lead: int):
        dims = len(turn)
        self.ids, self.whole = np.frombuffer(ids, np.int64), np.frombuffer(body, np.int64).reshape(-1, dims)
        turned = self.whole @ turn
        self.leading, self.rest = turned[:, :lead], np.sqrt((turned[:, lead:] ** 2).sum(1))
        self.length = np.sqrt((turned**2).sum(1))


def _searched(q: _Block, shard: list[_Block], least: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(place of query, candidate, score): each query's k best of a shard whose blocks come by length, if they reach ``least``."""
    floor = least.copy()
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for c in shard:
        top = c.length.max()
        slack = 1e-6 + 1e-9 * q.length * top
        live = np.flatnonzero(q.length * top + slack >= floor)
        if not len(live):
            break
        may = q.leading[live] @ c.leading.T + np.outer(q.rest[live], c.rest) + slack[live, None] >= floor[live, None]
        may &= q.ids[live, None] != c.ids[None, :]
        some_q, some_c = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if not len(some_q):
            continue
        score = _exact(q.whole[live[some_q]], c.whole[some_c])
        for i, row in enumerate(live[some_q].tolist()):
            place = np.flatnonzero(may[some_q[i], some_c])
            s, ids = score[i, place], c.ids[some_c[place]]
            if row in best:
                s, ids = np.r_[best[row][0], s], np.r_[best[row][1], ids]
            place = _best(s, ids, k)
            best[row] = s[place], ids[place]
            if len(place) == k:
                floor[row] = max(floor[row], s[place[-1]])
    return [(row, int(i), int(x)) for row, (s, ids) in best.items() for i, x in zip(ids, s, strict=True)]


def _cells(rotation: bytes, dims: int, lead: int, k: int):
    """(q_block, q_row, query_id, vec_id, score) of (cell, side, block, ids, vectors, least), which come by cell, candidates first, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = np.frombuffer(rotation).reshape(dims, dims)
        here, shard = None, []
        for batch in batches:
            rows: list[tuple] = []
            for cell, side, block, ids, body, least in zip(*(batch.column(n).to_pylist() for n in ("cell", "side", "block", "ids", "vectors", "least")), strict=True):
                if cell != here:
                    here, shard = cell, []
                one = _Block(ids, body, turn, lead)
                if side == 0:
                    shard.append(one)
                    continue
                rows += [(block, row, int(one.ids[row]), i, x) for row, i, x in _searched(one, shard, np.frombuffer(least), k)]
            names = ["q_block", "q_row", "query_id", "vec_id", "score"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest integer inner products.

    Both tables: vec_id, embedding; a component x counts as floor(64 * x). Candidates are all
    rows of another vec_id than the query's; ties go to the smaller vec_id.

    Null vectors, and those with a null or non-finite component, take no part; so do null
    vec_ids. A shorter vector counts as filled up with zeros (an empty one scores 0).
    A repeated candidate row is found once a copy; a repeated query is answered once a copy.
    Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    short_batches(spark)

    def whole(df: DataFrame) -> DataFrame:
        scaled = F.transform(F.col("embedding"), lambda x: F.floor(F.lit(64.0) * x.cast("double")))
        return df.filter(_usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), scaled.alias("v"))

    rows, asked = whole(vectors), whole(queries)
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    dims = max(rows.agg(F.max(F.size("v"))).first()[0] or 0, asked.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    schema = "block long, top double, ids binary, vectors binary"
    ordered = rows.withColumn("len", length).repartitionByRange(F.col("len").desc(), F.col("id")).sortWithinPartitions(F.col("len").desc())
    blocks = written(ordered.select("id", "v").mapInArrow(_blocks(dims), schema), "vectors")
    longest = blocks.orderBy(F.col("top").desc(), "block").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score long"
    if not longest:
        return spark.createDataFrame([], out)

    gram = np.zeros((dims, dims))
    for r in blocks.select("vectors").mapInArrow(_gram(dims), "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        gram[r.i, r.j] = r.s
    value, turn = np.linalg.eigh(gram)
    turn, value = turn[:, ::-1].copy(), np.maximum(value[::-1], 0)
    lead = int(np.searchsorted(np.cumsum(value), LEADING * value.sum()) + 1) if value.sum() else 1

    ask = asked.mapInArrow(_blocks(dims), schema)
    ask = written(ask.mapInArrow(_thresholds(longest[0].vectors, longest[0].ids, dims, k), "q_block long, q_ids binary, q_vectors binary, least binary, need double"), "queries")
    # Dealt by hash, so each shard and each group has long and short ones.
    count, asking = blocks.count(), ask.count()
    shards, groups = max(1, -(-count // SHARD)), max(1, -(-asking // GROUP))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cell = (F.col("shard") * groups + F.col("group")).alias("cell")
    sharded = blocks.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("long"))
    here = sharded.withColumn("group", every(groups))
    here = here.select(cell, F.lit(0).alias("side"), (-F.col("top")).alias("order"), "block", "ids", "vectors", F.lit(None).cast("binary").alias("least"))
    longest_of = sharded.groupBy("shard").agg(F.max("top").alias("top"))
    there = ask.withColumn("group", F.pmod(F.xxhash64("q_block"), F.lit(groups))).withColumn("shard", every(shards))
    there = there.join(longest_of, "shard").filter("top >= need - 1e-6 - 1e-9 * abs(need)")
    there = there.select(cell, F.lit(1).alias("side"), F.lit(0.0).alias("order"), F.col("q_block").alias("block"), F.col("q_ids").alias("ids"), F.col("q_vectors").alias("vectors"), "least")
    dealt = here.unionByName(there).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards * groups), "cell")
    found = dealt.sortWithinPartitions("cell", "side", "order", "block").select("cell", "side", "block", "ids", "vectors", "least")
    found = found.mapInArrow(_cells(turn.tobytes(), dims, lead, k), "q_block long, q_row long, query_id long, vec_id long, score long")
    # Equal rows of a copied candidate are told apart by nothing, so each counts.
    rank = F.expr("row_number() over (partition by q_block, q_row order by score desc, vec_id)")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
