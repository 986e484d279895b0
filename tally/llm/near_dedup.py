"""MinHash near-dedup: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard.

A text's set is that of its distinct word shingles, as 64-bit hashes; its sketch
holds the ``SKETCH`` smallest of them. Two texts are linked when their sets'
Jaccard similarity is at least the threshold; groups are the connected components.

Texts with equal sets are one *representative* from the start. Candidates come from
inverted lists of retained values:

* A value held by at most ``RARE`` representatives is rare, at any size of the corpus; others are common. They are told by blocks of sets: a value goes to the join once a block, however many
  of its texts hold it, and a block's common values come back as one list. A text lists itself
  under its smallest values; if one of these is common, under so many of its rare
  values that any partner must meet it (prefix filter on the sketch, non-rare
  values last). Such lists are short by definition, so their pairs are few.
* A text whose sketch is nearly all common values (large groups of near copies) is
  *crowded*. Each list of crowded texts has a hub, its most ordinary member, found with a
  map-side maximum, and every member is compared with it. Members that are linked to the
  hub are one group; those that aren't are compared with all members, a block of sets
  against a block of sets: one matrix product gives the exact overlaps of all pairs of
  two blocks, and only a spanning forest of the links found leaves the task. No group
  is in one task as a whole, and no pair becomes a row.

A partner is missed only if fewer than ``SHARED`` of the union's 64 smallest values
are in both sets (probability 5e-6 at similarity 0.8 exactly, far less above) or
none of the union's ``PREFIX`` smallest (1e-7); sets of up to 49 shingles are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import joined, short_batches, written
from .components import components

SKETCH = 64
PREFIX = 10
SHARED = 36
RARE = 64
#: Sets of a block, whose common values are told together.
TOLD = 1024
#: Members of a hub that meet one copy of its text.
HUB_ROWS = 256
#: Bytes of a block of sets of crowded texts.
BLOCK = 1 << 19


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n, sig, sketch = [], [], []
            for _, rows in words.word_hashes(texts):
                for row in rows:
                    found = words.shingles(row, size)
                    n.append(len(found))
                    sig.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    sketch.append(found[:SKETCH].tobytes())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "n", "sig", "sketch"])

    return run


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a set's block: up to TOLD sets that a task has one after the other, named by the first one's sig."""
    block, room = None, 0
    for batch in batches:
        of = []
        for sig in batch.column("sig").to_pylist():
            if not room:
                block, room = sig, TOLD
            of.append(block)
            room -= 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.binary())], [*batch.schema.names, "block"])


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, v, held): the values that a block's representatives retain, once each, and how many retain it."""
    block, parts = None, []

    def told() -> pa.RecordBatch:
        v, held = np.unique(np.frombuffer(b"".join(parts), np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([block] * len(v), pa.binary()), pa.array(v), pa.array(held, pa.int64())], ["block", "v", "held"])

    for batch in batches:
        for of, sketch in zip(batch.column("block").to_pylist(), batch.column("sketch").to_pylist(), strict=True):
            if of != block:
                if parts:
                    yield told()
                block, parts = of, []
            parts.append(sketch)
    if parts:
        yield told()


def _postings(least: float):
    """(v, node, n, crowded, usual): the lists that a block's representatives (node, n, sketch) go to; crowded ones go to PREFIX lists more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets, common in zip(batch.column("sets"), batch.column("common").to_pylist(), strict=True):
                yield block(sets.values, common or [])

    def block(sets: pa.StructArray, common: list[int]) -> pa.RecordBatch:
        sketches = [np.frombuffer(x, np.uint64) for x in sets.field("sketch").to_pylist()]
        any_hot = np.isin(np.concatenate(sketches).view(np.int64), np.array(common, np.int64))
        hots = np.split(any_hot, np.cumsum([len(x) for x in sketches])[:-1])
        v, node, size, full, usual = [], [], [], [], []
        for i, n, kept, hot in zip(sets.field("node").to_pylist(), sets.field("n").to_pylist(), sketches, hots, strict=True):
            first = min(PREFIX, n - int(np.ceil(least * n - 1e-9)) + 1)
            if not hot[:first].any():
                parts = [(kept[:first], False)]
            else:
                shared = min(int(np.ceil(least * n - 1e-9)), _shared(least)) if n < SKETCH else _shared(least)
                parts = [(kept[~hot][: len(kept) - shared + 1], False)]
                if hot.sum() >= shared:
                    parts.append((kept[:first], True))
            for values, crowded in parts:
                v.append(values)
                node += [i] * len(values)
                size += [n] * len(values)
                full += [crowded] * len(values)
                usual += [int(hot.sum())] * len(values)
        flat = np.concatenate(v).view(np.int64) if v else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(full, pa.bool_()), pa.array(usual, pa.int32())], ["v", "node", "n", "crowded", "usual"])

    return run


def _shared(least: float) -> int:
    """How many of the union's SKETCH smallest values two linked sets share, but for about 5e-6 of them."""
    return SHARED if least >= 0.8 else max(1, int(SKETCH * least - 4.6 * np.sqrt(SKETCH * least * (1 - least))))


def _estimated(least: float):
    """Keeps the pairs whose union sketch allows the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                union = np.union1d(x, y)[:SKETCH]
                both = np.intersect1d(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True)
                keep.append(len(both) >= (_shared(least) if len(union) == SKETCH else least * len(union) - 1e-9))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    return [words.shingles(row, size) for _, rows in words.word_hashes(column) for row in rows]


def _overlaps(size: int):
    """Intersection and union sizes of the full sets of two texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column("ta"), size), _sets(batch.column("tb"), size)
            inter = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)]
            union = [len(x) + len(y) - i for x, y, i in zip(*sets, inter, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "inter", "both"])

    return run


def _at_hub(size: int, percent: int):
    """A crowded text's set, and whether it is linked to its hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs: dict[int, np.ndarray] = {}
            sets, linked = _sets(batch.column("ta"), size), []
            for i, (hub, x) in enumerate(zip(batch.column("b").to_pylist(), sets, strict=True)):
                if hub not in hubs:
                    hubs[hub] = _sets(batch.column("tb").slice(i, 1), size)[0]
                inter = len(np.intersect1d(x, hubs[hub], assume_unique=True))
                linked.append(100 * inter >= percent * (len(x) + len(hubs[hub]) - inter))
            arrays = [batch.column("a"), batch.column("b"), pa.array([len(x) for x in sets], pa.int64()), pa.array(linked, pa.bool_()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "hub", "n", "linked", "set"])

    return run


def _forest(percent: int):
    """A spanning forest of the links between two blocks of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                ids, n, sets = [], [], []
                for side in (x, y):
                    ids.append(np.array([m["node"] for m in side]))
                    n.append(np.array([m["n"] for m in side]))
                    sets.append([np.frombuffer(m["set"], np.uint64) for m in side])
                shared = np.intersect1d(np.concatenate(sets[0]), np.concatenate(sets[1]))
                member = []
                for side in sets:
                    m = np.zeros((len(side), max(1, len(shared))), np.float32)
                    for i, s in enumerate(side):
                        m[i, np.searchsorted(shared, s[np.isin(s, shared, assume_unique=True)])] = 1
                    member.append(m)
                inter = np.rint(member[0] @ member[1].T).astype(np.int64)
                link = (100 * inter >= percent * (n[0][:, None] + n[1][None, :] - inter)) & (ids[0][:, None] != ids[1][None, :])
                # The smallest id that each reaches inside the two blocks.
                left, right = ids[0].copy(), ids[1].copy()
                far = np.iinfo(np.int64).max
                while True:
                    new_right = np.minimum(right, np.where(link, left[:, None], far).min(0))
                    new_left = np.minimum(left, np.where(link, new_right[None, :], far).min(1))
                    if (new_left == left).all() and (new_right == right).all():
                        break
                    left, right = new_left, new_right
                for own, least in ((ids[0], left), (ids[1], right)):
                    a += own[own != least].tolist()
                    b += least[own != least].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _compared(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``pairs`` (a, b) with the overlap of their full sets, from the texts of the documents."""
    return _with_texts(pairs, texts).mapInArrow(_overlaps(size), "a long, b long, inter long, both long")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")


def _with_hubs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The same for pairs (member, hub): members of a hub are dealt to keys of about HUB_ROWS, and its text is copied to each."""
    hubs = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("size")).withColumn("many", F.ceil(F.col("size") / HUB_ROWS).cast("long"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")).join(hubs.drop("size"), "b")
    two = two.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1))).drop("many")
    dealt = joined(pairs, hubs, "b", "size", pairs.count()).withColumn("part", F.pmod(F.xxhash64("a"), F.col("many")))
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    return dealt.join(one, "a").join(two, ["b", "part"]).select("a", "b", "ta", "tb")


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    ``size``: words of a shingle; ``percent``: least similarity, in hundredths, 80 or more.
    component_id is the smallest doc_id of the row's group; kept marks that row.

    Null or empty texts and texts without words have no shingles and are linked with
    nothing (but with other rows of their id). Shorter texts than a shingle are one shingle. A null doc_id is in no group
    (component_id null, kept true). Rows that share a doc_id are versions of one
    document: linked by the id, all kept or none. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    short_batches(spark)
    least = percent / 100
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    rows = written(docs.mapInArrow(_sketches(size), "doc_id long, n long, sig binary, sketch binary"), "sketches")
    sets = rows.filter("doc_id is not null and n > 0")
    sets_of = sets.groupBy("sig").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    one_each = written(sets_of.mapInArrow(_blocked, "sig binary, node long, n long, sketch binary, copies long, block binary"), "sets")
    reps = one_each.select("node", "n", "sketch")

    values = one_each.select("block", "sketch").mapInArrow(_values, "block binary, v long, held long")
    held = written(values.groupBy("v").agg(F.sum("held").alias("held")).filter(f"held > {RARE}").select("v"), "held")
    common = values.join(held, "v", "left_semi").groupBy("block").agg(F.collect_list("v").alias("common"))  # TOLD * SKETCH at most
    known = one_each.groupBy("block").agg(F.collect_list(F.struct("node", "n", "sketch")).alias("sets")).join(common, "block", "left").select("sets", "common")
    lists = written(known.mapInArrow(_postings(least), "v long, node long, n long, crowded boolean, usual int"), "lists")

    sized = F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
    rare = lists.filter("not crowded")
    rare = rare.alias("x").join(rare.alias("y"), "v").filter("x.node < y.node").filter(sized).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    sketch_of = reps.select("node", "sketch")  # of a repeated id, all of its versions' sketches

    def likely(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sketch_of.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
        both = with_a.join(sketch_of.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
        return both.select("a", "b", "sa", "sb").mapInArrow(_estimated(least), "a long, b long").distinct()

    candidates = written(likely(rare), "candidates")
    crowd = lists.filter("crowded")
    crowded = crowd.select("node").distinct()
    needed = candidates.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(crowded.select(F.col("node").alias("doc_id"))).distinct()
    texts = written(docs.join(needed, "doc_id", "left_semi"), "texts")

    linked = F.expr(f"100 * inter >= {percent} * both")
    links = written(_compared(candidates, texts, size).filter(linked).select("a", "b"), "links")
    if not crowd.isEmpty():
        hubs = crowd.groupBy("v").agg(F.max_by("node", F.struct("usual", F.xxhash64("node"))).alias("hub"))
        at_hub = crowd.join(hubs, "v").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
        at_hub = written(at_hub, "members")
        apart = _with_hubs(at_hub, texts).mapInArrow(_at_hub(size, percent), "node long, hub long, n long, linked boolean, set binary")
        apart = written(apart, "apart")
        links = links.unionByName(apart.filter("linked and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
        member, members = F.struct("node", "n", "set"), apart.count()

        def blocks(side: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
            """Members of a hub dealt by hash to blocks of about BLOCK bytes, and the number of blocks of each hub."""
            many = side.groupBy("hub").agg(F.ceil(F.sum(8 * F.col("n")) / BLOCK).cast("long").alias("many"), F.count(F.lit(1)).alias("size"))
            dealt = joined(side, many, "hub", "size", members).withColumn("block", F.pmod(F.xxhash64("node"), F.col("many")))
            return dealt.groupBy("hub", "block").agg(F.collect_list(member).alias(name)), many.select("hub", "many")

        # Every block that holds a text apart from its hub meets every block of that hub, each pair of blocks by its own key.
        (x, _), (y, of_hub) = blocks(apart.filter("not linked"), "x"), blocks(apart, "y")
        x = x.drop("block").join(of_hub, "hub").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
        met = x.join(y, ["hub", "block"])
        # Dealt anew: a task gets a few pairs of blocks, whatever hub they have.
        met = met.select("x", "y").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2))
        links = links.unionByName(met.mapInArrow(_forest(percent), "a long, b long"))

    # Rows that share an id are linked by it: the id is tied to each of its sets.
    versions = sets.select("doc_id", "sig").distinct()
    repeated = versions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    tied = versions.join(repeated, "doc_id").join(one_each.select("sig", "node"), "sig")
    groups = components(links.unionByName(tied.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))))
    # Of equal sets there may be any number: they are a frequent key. Rows without a set go by their id.
    sized = one_each.select("sig", "node", "copies").join(groups, "node", "left").select("sig", "copies", F.coalesce("component", "node").alias("grp"))
    some = rows.filter("doc_id is not null and n > 0").select("doc_id", F.col("n").alias("n_shingles"), "sig")
    with_set = joined(some, sized, "sig", "copies", rows.count()).select("doc_id", "n_shingles", F.col("grp").alias("component_id"))
    none = rows.filter("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"))
    by_id = with_set.join(none.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "component_id").distinct()
    none = none.join(by_id, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    named = with_set.unionByName(none)
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near copies, all columns kept.

    Rows without a doc_id, and texts without words, stay. Rows that share a doc_id stay or go together.
    An empty table gives an empty one.
    """
    kept = near_groups(docs, size, percent).filter("kept and doc_id is not null").select("doc_id").distinct()
    return docs.filter("doc_id is null").unionByName(docs.join(kept, "doc_id", "left_semi").select(docs.columns))
