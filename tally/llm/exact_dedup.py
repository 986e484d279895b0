"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one id.

Rows are grouped by the MD5 of the text without moving texts. Only texts whose hash occurs more
than once are then compared, which a broadcast bitmap of such hashes tells from most others before
anything is joined: they are grouped by hash and text, which compares bytes and combines
equal texts on the map side, so a large group moves one text a task. Texts that differ in spite of
equal hashes (collisions) are grouped by the text itself. A group may be any share of the rows:
hashes of many rows are broadcast instead of joined by key (``common.joined``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, written


#: Bits of the bitmap of hashes that occur more than once: 2 MB at any size of the corpus.
BITS = 1 << 24


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _maybe(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose key isn't one of ``keys``: a bitmap of BITS bits, in pieces of 4 kB, is broadcast."""
    bit = F.pmod(F.xxhash64("key"), F.lit(BITS)).alias("bit")
    maps = keys.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    there = F.expr("shiftright(cast(conv(hex(substring(map, cast(at div 8 as int) + 1, 1)), 16, 10) as int), cast(at % 8 as int)) & 1") == 1
    marked = rows.withColumn("bit", bit).withColumn("piece", F.bitmap_bucket_number("bit")).withColumn("at", F.bitmap_bit_position("bit"))
    return marked.join(F.broadcast(maps), (marked["piece"] == maps["piece"]) & there, "left_semi").select(rows.columns)


def exact_groups(docs: DataFrame, keep: str = "largest", digest=_digest) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs`` (doc_id, text).

    ``keep``: "largest" or "smallest" doc_id of equal texts stays. ``digest``: the content hash.

    A null text counts as the empty text, and all empty texts are one group. A null doc_id
    loses against any other; a group of such rows only has keep_id null and all rows kept.
    Rows that repeat both doc_id and text are all marked kept (exact_dedup leaves one).
    Other columns are ignored; an empty table gives an empty one.
    """
    best = {"largest": F.max, "smallest": F.min}[keep]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", digest(F.col("text")))
    digests = written(rows.select("doc_id", "key", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "digests")
    groups = written(digests.groupBy("key").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "sizes")

    total = digests.count()
    several = groups.filter("group_size > 1").select("key", "group_size")
    texts = joined(_maybe(rows, several), several, "key", "group_size", total).groupBy("key", "text").agg(F.count(F.lit(1)).alias("n"))
    collided = written(texts.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("key"), "collided")

    if collided.isEmpty():
        out = joined(digests, groups, "key", "group_size", total)
    else:
        plain = joined(digests.join(collided, "key", "left_anti"), groups, "key", "group_size", total)
        clash = _maybe(rows, collided).join(collided, "key", "left_semi")
        each = clash.groupBy("key", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        clash = clash.join(each, ["key", "text"]).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
        out = plain.unionByName(clash.select(plain.columns))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    A null text counts as empty. Rows that repeat both doc_id and text leave one of them; rows without a doc_id
    go if another row has their text, else one of them stays for each text. An empty table gives an empty one.
    """
    stay = written(exact_groups(docs, keep).filter("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("times")), "stay")
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), sha.alias("sha"))
    match = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256"))
    once = marked.join(stay.filter("times = 1"), match, "left_semi")
    if not stay.filter("times > 1").isEmpty():
        again = marked.join(stay.filter("times > 1"), match, "left_semi")
        once = once.unionByName(again.groupBy("id", "sha").agg(F.first("row").alias("row")).select("row", "id", "sha"))
    return once.select("row.*")
