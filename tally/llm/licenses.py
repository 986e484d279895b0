"""License scans by diagonal voting.

All rolling k-grams of a text's words are joined to the positions of the same k-grams in
license templates. Hits of one notice lie on one diagonal (place in the text less place in
the template), those of a slightly changed one on neighbouring diagonals: hits are counted
by diagonal, neighbouring diagonals are merged to spans, and a span is verified by the
share of the template's k-grams that it holds. Beside this, the places of set
phrases are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import short_batches

#: Words of a k-gram.
GRAM = 3
#: Diagonals further apart than this are different spans.
GAP = 4
#: Share of a template's k-grams that a span must hold: of short templates (up to SHORT words) and long ones.
SHORT, SHORT_SHARE, LONG_SHARE = 12, 0.75, 0.5

# The set phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices as the licenses give them, in part.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("proprietary", "all rights reserved no part of this may be reproduced"),
]

_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


def _hashed(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words.hashes(data, *words.spans(data, np.zeros(0, np.int64), _GAP))


def _grams(hashed: np.ndarray) -> np.ndarray:
    n = len(hashed) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64)
    acc = np.full(n, np.uint64(GRAM))
    for i in range(GRAM):
        acc = words.mix(acc * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + n])
    return acc.view(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(row, digest, word hashes) of the rows of (doc_id, text)."""
    data, offsets = words.text_buffers(batch.column(1))
    row = 0
    while row < len(offsets) - 1:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + words.CHUNK, "right")) - 1)
        part = data[offsets[row] : offsets[stop]]
        bounds = offsets[row : stop + 1] - offsets[row]
        starts, ends = words.spans(part, bounds, _GAP)
        each = np.split(words.hashes(part, starts, ends), np.searchsorted(starts, bounds[1:-1]))
        for i, hashed in enumerate(each):
            yield row + i, xxhash.xxh3_128_digest(part[bounds[i] : bounds[i + 1]].tobytes()), hashed
        row = stop


def _all_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, grams = [], []
        for _, digest, hashed in _texts(batch):
            digests.append(digest)
            grams.append(_grams(hashed))
        at = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
        flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["doc_id", "digest", "grams"])


def _base(phrases: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(label, _hashed(p)) for p, label in phrases.items()]
        for batch in batches:
            rows = []
            for _, digest, hashed in _texts(batch):
                places, labels = [], set()
                for label, p in known:
                    n = len(hashed) - len(p) + 1
                    if n < 1:
                        continue
                    at = np.flatnonzero(hashed[:n] == p[0])
                    for i in range(1, len(p)):
                        at = at[hashed[at + i] == p[i]]
                    if len(at):
                        places += at.tolist()
                        labels.add(label)
                rows.append((digest, len(hashed), len(places), min(places, default=None), max(places, default=None), sorted(labels)))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            arrays = [batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "digest", "n_words", "n_base", "first_word", "last_word", "base"])

    return run


def template_grams(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(gram, template, label, place, size): the positions of the templates' k-grams. As small as the templates."""
    rows = []
    for number, (label, text) in enumerate(templates):
        hashed = _hashed(text)
        share = SHORT_SHARE if len(hashed) <= SHORT else LONG_SHARE
        grams = _grams(hashed).tolist()
        rows += [(g, number, label, place, len(grams), share) for place, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template int, label string, place int, size int, share double")


def license_spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, digest, template, label, start, stop, votes, coverage): the verified spans of ``docs`` (doc_id, text).

    start and stop are word numbers, stop exclusive; digest tells texts apart where ids repeat.
    Equal rows give equal spans once. Null and short texts have none.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_all_grams, "doc_id long, digest binary, grams array<long>")
    rolled = rows.select("doc_id", "digest", F.posexplode("grams").alias("at", "gram"))
    # Bounded: the templates are part of the program.
    hits = rolled.join(F.broadcast(template_grams(spark, templates)), "gram")
    own = ["doc_id", "digest", "template", "label", "size", "share"]
    lines = hits.withColumn("diagonal", F.col("at") - F.col("place")).groupBy(*own, "diagonal")
    lines = lines.agg(F.count("*").alias("votes"), F.collect_set("place").alias("places"), F.min("at").alias("start"), (F.max("at") + GRAM).alias("stop"))
    order = f"over (partition by doc_id, digest, template order by diagonal)"  # noqa: F541
    lines = lines.withColumn("opens", F.expr(f"coalesce(diagonal - lag(diagonal) {order} > {GAP}, true)"))
    lines = lines.withColumn("span", F.expr(f"sum(cast(opens as int)) {order}"))
    spans = lines.groupBy(*own, "span").agg(
        F.sum("votes").alias("votes"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"),
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
    )
    spans = spans.withColumn("coverage", F.col("held") / F.col("size")).filter("coverage >= share").distinct()
    return spans.select("doc_id", "digest", "template", "label", "start", "stop", "votes", "coverage")


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of ``docs``.

    score: the best verified span's coverage, 0.9 at least where a phrase stands; else 0. Null, empty and
    wordless texts have n_words 0, no labels ("") and null places. Rows with a null doc_id are scanned, too.
    """
    short_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _base(phrases), "doc_id long, digest binary, n_words long, n_base long, first_word long, last_word long, base array<string>"
    )
    best = license_spans(docs, templates).groupBy("doc_id", "digest").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best"))
    best = best.select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), "more", "best")
    both = base.join(best, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left")
    none = F.array().cast("array<string>")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", F.array_sort("base")).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.coalesce("more", none)))).alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.9).otherwise(0.0))).alias("score"),
    )
