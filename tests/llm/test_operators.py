"""Each operator against brute force on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tally.llm import components, exact_dedup, language, licenses, near_dedup, packing, pieces, pii, scoring, tokens, top_k, toxicity
from tally.llm import words as W
from tally.llm.queries import byte_bpe_path, piece_model_path

R = random.Random(3)
VOCABULARY = [f"{a}{b}" for a in "ba ke lo mi tu".split() for b in "ra ne so pi du".split()] + ["Zé", "naïve", "x1"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sentence(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


BASE = sentence(120)
TEXTS = [
    None, "", "   \n\t ", "one", "two words", BASE, BASE, BASE.replace("ba", "BA"), BASE + " end", " ".join(BASE.split()[:110] + ["new"]), sentence(80), sentence(3000),
    "Card 4845 1681 1440 7329 or bob@acme.org", "Released under the MIT License.\n" + sentence(20), "Licensed under the Apache License, Version 2.0.", "é 😀 \x00 <|endoftext|> ▁▁ a", "x" * 5000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], "s", 0, "n", i) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", "s", 0, "n", 5), (None, BASE, "en", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_groups(docs, empty):
    got = near_dedup.near_groups(docs, 4, 80).collect()
    assert len(got) == docs.count()
    sets = {}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), group[r.doc_id], group[r.doc_id] == r.doc_id)
    kept = near_dedup.near_dedup(docs, 4, 80)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in group if group[i] == i} | {None}
    assert near_dedup.near_groups(empty).count() == 0


def test_rows_that_share_an_id(spark):
    """Versions of one document link the groups of all their texts; those without words go along."""
    a, b, c = sentence(60), sentence(60), sentence(60)
    rows = [(3, a), (5, a), (5, b), (7, b), (5, None), (8, c), (9, c + " end"), (9, a.replace("ba", "zz")), (4, ""), (4, sentence(50))]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(3, 3), (5, 3), (7, 3), (8, 8), (9, 8), (4, 4)} and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_crowded_near_copies(spark, monkeypatch):
    """Common values only: groups come from hubs and blocks of sets, and are those of brute force."""
    monkeypatch.setattr(near_dedup, "RARE", 8)
    base = [R.choice(VOCABULARY) + str(R.randrange(40)) for _ in range(90)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(R.randrange(9)):
            w[R.randrange(len(w))] = f"e{R.randrange(400)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[k : k + 4]) for k in range(87)} for t in texts]
    group = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 80)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(group))


def test_common_values_are_joined_by_block(spark, monkeypatch):
    """A value that many near copies hold goes to the join once a block, not once a copy, and so do common ones leave it."""
    monkeypatch.setattr(near_dedup, "RARE", 8)
    written, found = near_dedup.written, {}
    monkeypatch.setattr(near_dedup, "written", lambda df, name: found.setdefault(name, written(df, name)))
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:k], f"other{k}", *base[k + 1 :]]) for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r.component_id for r in near_dedup.near_groups(docs, 4, 80).collect()} == {0}
    sets, held = found["sets"], found["held"]
    values = sets.mapInArrow(near_dedup._values, "block binary, v long, held long")
    common, blocks = values.join(held, "v", "left_semi").count(), sets.rdd.getNumPartitions()
    assert sets.count() == 200 and common <= blocks * held.count() and common < 200 * near_dedup.SKETCH / 8


def test_components_end_at_a_star_forest(spark, monkeypatch):
    """Links that are stars already take no step; a chain takes few and is one component."""
    steps = []
    small = components._small_star
    monkeypatch.setattr(components, "_small_star", lambda edges: steps.append(1) or small(edges))
    stars = spark.createDataFrame([(1, 9), (9, 1), (5, 1), (7, 7), (2, 3)], "a long, b long")
    assert {tuple(r) for r in components.components(stars).collect()} == {(1, 1), (9, 1), (5, 1), (2, 2), (3, 2)} and not steps
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (100, 60)], "a long, b long")
    got = {r.node: r.component for r in components.components(chain).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 60: 50, 100: 50} and 1 <= len(steps) <= 10
    assert components.components(stars.limit(0)).count() == 0


def test_pii(spark, docs, empty):
    values = ["4845168114407329", "4845168114407328", "10.2.3.4", "300.2.3.4", "2024-02-29", "2023-02-30", "123-45-6789", "+1 (017) 555-7713", "ann@host.org", "DE89 3704 0044 0532 0130 00"]
    rows = spark.createDataFrame([(i, f"a {v}, b {v}!") for i, v in enumerate(values)], "doc_id long, text string")
    got = [r.text for r in pii.pseudonyms(rows).orderBy("doc_id").collect()]
    for v, text in zip(values, got, strict=True):
        first, second = re.fullmatch(r"a (.*), b (.*)!", text).groups()
        assert first == second and re.sub(r"\d", "9", first) == re.sub(r"\d", "9", v) or "@" in v or "." in v
        assert (first == v) == (v in ("4845168114407328", "300.2.3.4", "2023-02-30"))
    other = [r.text for r in pii.pseudonyms(rows, key="other").orderBy("doc_id").collect()]
    assert got[0] != other[0]
    size = 50
    mapped = spark.range(size).select(pii.permute_number(F.col("id"), size, "k", "t").alias("x"))
    assert {r.x for r in mapped.collect()} == set(range(size))
    three = spark.range(1000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("x"))
    assert three.distinct().count() == 1000
    out = pii.pseudonyms(docs)
    assert out.count() == docs.count() and out.filter("text is null").count() == 1
    assert {r.doc_id for r in out.filter("pii_changed > 0").collect()} == {12}
    assert pii.pseudonyms(empty).count() == 0


def test_pii_is_a_permutation(spark):
    """Different mail boxes, hosts and tokens get different pseudonyms of their own pattern; equal ones link, whatever the capitals."""
    boxes = [f"{R.choice('abcdefg')}{R.choice('hijk')}{i}.x@h{i % 97}.org" for i in range(2000)]
    rows = spark.createDataFrame([(i, f"to {b} now") for i, b in enumerate(boxes)], "doc_id long, text string")
    got = [r.text[3:-4] for r in pii.pseudonyms(rows).orderBy("doc_id").collect()]
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[0-9]", "0", t))
    assert len(set(got)) == len(set(boxes)) and all(shape(x) == shape(y) for x, y in zip(got, boxes, strict=True))
    small = spark.range(1296).select(F.concat(*(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), (F.col("id") / d % 36 + 1).cast("int"), F.lit(1)) for d in (1, 36))).alias("v"))
    out = [r.x for r in small.select(pii.permute_characters(F.col("v"), "k", "t").alias("x")).collect()]
    assert len(set(out)) == 1296 == len({*out} & {a + b for a in "abcdefghijklmnopqrstuvwxyz0123456789" for b in "abcdefghijklmnopqrstuvwxyz0123456789"})
    (one,) = pii.pseudonyms(spark.createDataFrame([("Ann.B@Host.org ann.b@host.org " + "0aF9" * 10 + " " + "ab12" * 10,)], "text string")).collect()
    first, second, _, token = one.text.split()
    assert first.lower() == second and first != second and re.fullmatch("[0-9a-f]{40}", token) and token != "ab12" * 10


def test_pii_keeps_clashing_columns(spark):
    rows = spark.createDataFrame([("bob@acme.org", "mine", 7, 8, ["a"])], "text string, pii_found string, pii_changed int, PII_VALUES int, pii_new array<string>")
    out = pii.pseudonyms(rows)
    assert out.columns == [*rows.columns, "pii_found_1", "pii_changed_1"]
    r = out.first()
    assert (r.pii_found, r.pii_changed, r.PII_VALUES, r.pii_new, r.pii_found_1, r.pii_changed_1) == ("mine", 7, 8, ["a"], 1, 1) and r.text != "bob@acme.org"


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe_path())
    got = packing.pack(docs, byte_bpe_path(), capacity=256, with_ids=True).collect()
    for i in {r.doc_id for r in got} - {None, 5}:
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        ids = [x for r in own for x in r.ids]
        assert ids == [*t.encode(TEXTS[i] or "", add_special_tokens=False).ids, 0]
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        assert all(r.length == 256 for r in own[1:]) and all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in own)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(r.length for r in got) // 256) + 1
    assert packing.pack(empty, byte_bpe_path()).count() == 0


def test_plan_holds_everything():
    for seed in range(5):
        r = np.random.default_rng(seed)
        lengths = r.integers(1, 101, 400)
        histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
        kinds = packing.plan(histogram, 100)
        back = {}
        for contents, count in kinds:
            assert sum(n * k for n, k in contents) <= 100
            for n, k in contents:
                back[n] = back.get(n, 0) + k * count
        assert back == histogram and sum(c for _, c in kinds) <= 1.1 * -(-lengths.sum() // 100) + 1


def test_toxicity(spark, docs, empty):
    texts = [(sentence(30) + (" you idiot and moron. " if i % 3 == 0 else " ") + sentence(20), int(i % 3 == 0)) for i in range(150)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(texts)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(rows, labels).collect()}
    assert all(got[i].predicted == y and 0 <= got[i].score <= 1 for i, (_, y) in enumerate(texts))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert {r.doc_id for r in toxicity.drop_toxic(rows, labels).collect()} == {i for i, (_, y) in enumerate(texts) if not y}
    assert toxicity.toxicity(docs, labels.limit(0)).count() == docs.count() and toxicity.toxicity(empty, labels).count() == 0
    g = toxicity.Grammar({"idiot": 4.0, "lowe*": 5.0}, {"kill": 3.0})
    assert g.clause("you idiot".split())[0] > g.clause("not an idiot".split())[0] < g.clause("an idiot".split())[0]
    assert g.clause("he said idiot".split())[0] < g.clause("he is idiot".split())[0]
    assert g.clause(["kill", "time"])[0] < g.clause(["kill", "you"])[0] and g.clause(["loweisch"])[1] == 1


def test_grammar_by_brute_force():
    """Clause scores against all paths through the five transducers, one after the other, and against the rules in words."""
    machines = [toxicity.insult_transducer(), toxicity.threat_transducer(), toxicity.target_transducer(), toxicity.negation_transducer(), toxicity.reported_transducer()]

    def through(m, tags):
        paths = [(s, [], []) for s in m.starts]
        for t in tags:
            paths = [(to, out + [o], xs + [x]) for s, out, xs in paths for to, o, x in m.arcs.get((s, t), ())]
        return [(out, xs) for s, out, xs in paths if s in m.finals]

    words = {"idiot": ("hit", 4.0), "kill": ("threat", 3.0), "you": ("who", 0), "not": ("not", 0), "said": ("say", 0), "tree": ("", 0)}
    g = toxicity.Grammar({"idiot": 4.0}, {"kill": 3.0})
    r = random.Random(6)
    for _ in range(300):
        clause = [r.choice(list(words)) for _ in range(r.randrange(1, 8))]
        found = [([words[w][0] for w in clause], [1.0] * len(clause))]
        for m in machines:
            found = [(out, [x * y for x, y in zip(xs, ys, strict=True)]) for tags, xs in found for out, ys in through(m, tags)]
        assert len(found) == 1
        by_path = sum(words[w][1] * x for w, x in zip(clause, found[0][1], strict=True))
        aimed, told = "you" in clause, "said" in clause
        by_rule = sum(
            words[w][1] * (1.25 if aimed else 1) * (0.5 if told else 1) * (0.3 if w == "kill" and not aimed else 1)
            * (0.25 if "not" in clause[max(0, i - toxicity.SCOPE) : i] else 1)
            for i, w in enumerate(clause)
        )
        assert g.clause(clause)[0] == pytest.approx(by_path) == pytest.approx(by_rule)
    assert g.clause(["kill", "you"]) == g.clause(["you", "kill"]) and g.clause("idiot he said".split()) == g.clause("he said idiot".split())


def test_texts_that_occur_once_are_left_before_any_join(spark):
    """Every row of a repeated hash stays, hardly any other."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.unhex(F.md5(F.col("id").cast("string").cast("binary"))).alias("key"))
    some = rows.filter("doc_id % 20 = 0")
    got = {r.doc_id for r in exact_dedup._maybe(rows, some.select("key")).collect()}
    assert got >= set(range(0, 20_000, 20)) and len(got) < 1_050


def test_exact_groups(docs, empty):
    def check(got):
        for r in got:
            if r.doc_id is None:
                continue
            same = [i for i, t in enumerate(TEXTS) if (t or "") == (TEXTS[r.doc_id] or "")]
            extra = 2 if TEXTS[r.doc_id] == BASE else 0
            assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same) + extra, r.doc_id == max(same))
            assert r.text_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()

    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == docs.count()
    check(got)
    # A digest with collisions only: texts are told apart by their bytes.
    check(exact_dedup.exact_groups(docs, digest=lambda t: F.unhex(F.md5(F.substring(t, 1, 0).cast("binary")))).collect())
    kept = exact_dedup.exact_dedup(docs, keep="smallest")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({TEXTS.index(t) if t is not None else 0 for t in TEXTS} - {1})
    assert exact_dedup.exact_groups(empty).count() == 0


def test_scores(spark, docs, empty):
    rows = [(i, sentence(40) + (" sole%d" % i), "en") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in scoring.scores(df).collect()}
    train = {}
    for i, t, _ in rows:
        if zlib.crc32(str(i).encode()) % 10:
            for w in [*scoring.tokens(t), "end"]:
                train[w] = train.get(w, 0) + 1
    n, v = sum(train.values()), len(train)
    for i, t, _ in rows:
        w = [*scoring.tokens(t), "end"]
        base = sum(np.log10((train.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert abs(got[i].base_score - base) < 1e-6 and got[i].n_tokens == len(w) and got[i].n_known == sum(x in train for x in w) and got[i].train_tokens == n
        assert got[i].score < 0 and got[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    assert scoring.scores(docs).count() == docs.count() and scoring.scores(empty).count() == 0


def pairs_of(rows):
    """Sorted distinct (spelled, kind) pairs with training counts, as the buckets hold them."""
    total = {}
    for spelled, kind, n in rows:
        total[spelled, kind] = total.get((spelled, kind), 0) + n
    keys = sorted(total)
    return [k[0] for k in keys], np.array([k[1] for k in keys]), np.array([total[k] for k in keys], float)


def slow_scores(spelled, kind, n, first, mixer, tables):
    """The mixer bit by bit, with counts from dictionaries: the same order, no runs, no arrays."""
    weights, last, steps = mixer.weights.astype(float).tolist(), mixer.last.tolist(), mixer.steps.tolist()
    level = lambda c: sum(c > e for e in (0.5, 1.5, 4.5, 20.5, 200.5))
    seen = {}
    for w, k, c in zip(spelled, kind, n, strict=True):
        for d in range(len(w)):
            for j in range(8):
                bit = w[d] >> (7 - j) & 1
                for name in ((w[:d], w[d] >> (8 - j), j), (w[:d], w[d] >> (8 - j), j, k)):
                    seen.setdefault(name, [0, 0])[bit] += c
    total = [0.0] * len(spelled)
    for d in range(max(map(len, spelled))):
        rows = [i for i, w in enumerate(spelled) if first[i] <= d < len(w)]
        for j in range(8):
            jobs = []
            for i in rows:
                w, bit, node = spelled[i], spelled[i][d] >> (7 - j) & 1, 1 << j | spelled[i][d] >> (8 - j)
                before = [w[d - b] if d >= b else 32 for b in (1, 2, 3)]
                base = [(before[1] << 8 | before[0]) << 8, (before[2] << 16 | before[1] << 8 | before[0]) << 8]
                counts = [[float(c) for c in tables.reshape(-1, 2)[scoring.Bucket.slot(t, np.array([x]), np.array([node]))[0]]] for t, x in enumerate(base)]
                counts += [seen[w[:d], w[d] >> (8 - j), j], seen[w[:d], w[d] >> (8 - j), j, kind[i]]]
                for own in (0, 1):
                    c = [[max(z - own * (1 - bit), 0), max(o - own * bit, 0)] for z, o in counts]
                    x = [np.log(np.float32(o) + np.float32(0.02)) - np.log(np.float32(z) + np.float32(0.02)) for z, o in c] + [0.3]
                    jobs.append((i, bit, x, level(sum(c[2])) * 6 + level(sum(c[3]))))
            errors, many, marks = {}, {}, []
            for at, (i, bit, x, gate) in enumerate(jobs):
                dot = min(12, max(-12, sum(a * b for a, b in zip(x, weights[gate], strict=True))))
                p, cell = 1 / (1 + np.exp(-dot)), gate * 33 + int(np.rint((dot + 12) * 32 / 24))
                if at % 2 == 0:
                    q = (p + (last[cell][0] + 16 * p) / (last[cell][1] + 16)) / 2
                    q = min(1 - 1e-6, max(1e-6, q))
                    total[i] += np.log10(q if bit else 1 - q)
                else:
                    marks.append((cell, n[i] * bit, n[i]))
                    many[gate] = many.get(gate, 0) + n[i]
                    e = errors.setdefault(gate, [0.0] * 5)
                    for k in range(5):
                        e[k] += (bit - p) * n[i] * x[k]
            for cell, ones, c in marks:
                last[cell][0] += ones
                last[cell][1] += c
            for gate, e in errors.items():
                rate = (0.02 + 0.4 / (1 + steps[gate] / 30)) / max(many[gate], 1e-9)
                weights[gate] = [a + rate * b for a, b in zip(weights[gate], e, strict=True)]
                steps[gate] += many[gate] > 0
    return total


def peak(f):
    """What ``f`` gives, and the MB that Python and numpy held at most meanwhile."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_mixer_by_brute_force():
    """Twenty short texts: the same scores from a loop over bits with dictionaries."""
    texts = [sentence(R.randrange(1, 9)) for _ in range(20)]
    found = scoring.Tokens({b"bara": 1, b"keso": 2})
    word, kind, _, _ = found.lot([(i, t.encode().translate(scoring._LOWER), True) for i, t in enumerate(texts)], -1)
    names = [scoring.spell(k) for k in found.place]
    spelled, kinds, n = pairs_of((names[w], int(k), i % 3 != 0) for i, (w, k) in enumerate(zip(word.tolist(), kind.tolist(), strict=True)))
    tables = np.zeros(2 * sum(scoring.SIZES), np.float32)
    whole = scoring.Bucket(spelled, kinds, n, np.zeros(len(n), np.int64))
    whole.count(tables)
    # The tables by counting each bit of each word.
    bits = sum(8 * len(w) * c for w, c in zip(spelled, n, strict=True))
    assert tables.reshape(-1, 2)[: scoring.SIZES[0]].sum() == bits == tables.sum() / 2
    for first in (0, 2):
        at = np.minimum(first, [len(w) for w in spelled])
        keep = [i for i, w in enumerate(spelled) if len(w) > first]
        part = [spelled[i] for i in keep], kinds[keep], n[keep], at[keep]
        mixer = scoring.Mixer()
        mixer.steps[:] = 30
        want = slow_scores(*part, mixer.begun(), tables)
        assert np.allclose(mixer.begun().run(scoring.Bucket(*part), tables), want, rtol=1e-3, atol=1e-3)


def test_spelling_is_a_distribution(monkeypatch):
    """All bytes that can come next sum to one, in each class, while the mixer learns."""
    monkeypatch.setattr(scoring, "STEP", 16)
    spelled, kinds, n = pairs_of((bytes([b]), k, (b * 7 + k) % 5 * (b % 3 == 0)) for b in range(256) for k in range(3))
    tables = np.zeros(2 * sum(scoring.SIZES), np.float32)
    bucket = scoring.Bucket(spelled, kinds, n, np.zeros(len(n), np.int64))
    bucket.count(tables)
    mixer = scoring.Mixer()
    for _ in range(3):
        score = mixer.run(bucket, tables)
        for k in range(3):
            assert abs((10.0 ** score[kinds == k]).sum() - 1) < 1e-3


def test_frequent_words_before():
    """Classes follow the last frequent word of the text, over any number of words and over pieces of a text."""
    found = scoring.Tokens({b"the": 1, b"of": 2})
    word, kind, row, after = found.lot([(0, b"a the b c of d", True), (1, b"x the y", False)], -1)
    assert kind.tolist() == [0, 0, 1, 1, 1, 2, 2, 0, 0, 1] and row.tolist() == [0] * 7 + [1] * 3 and after == 1
    word, kind, _, _ = found.lot([(1, b"z of", False), (1, b" q", True)], after)
    assert kind.tolist() == [1, 1, 2, 2]
    long = b"w" * 70
    word, kind, _, _ = found.lot([(0, b"the " + long + b" e", True)], -1)
    names = [scoring.spell(k) for k in found.place]
    assert [names[w] for w in word[1:4]] == [long[:32], long[:32], long[:6] + b" "] and names[word[4]][0] == 0xFF
    assert kind.tolist() == [0, 1, scoring.CONTINUED, scoring.CONTINUED, scoring.LONG, 1, 1]


def test_scores_do_not_depend_on_tasks(spark, monkeypatch):
    """Any number of partitions, small heads and short chunks give the same scores; a very long word and text are read."""
    rows = [(i, sentence(R.randrange(60))) for i in range(150)] + [(500, "y" * 3_000_000), (501, sentence(50) + " " + "q" * 70 + " " + sentence(30)), (502, None), (None, "ba")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    read = lambda: {r.doc_id: [r[c] for c in columns] for r in scoring.scores(df).collect()}
    want = read()
    df = df.repartition(7)
    monkeypatch.setattr(scoring, "HEAD", 20)
    monkeypatch.setattr(scoring, "CHUNK", 500)
    monkeypatch.setattr(scoring, "COUNTED", 15)
    got = read()
    assert want.keys() == got.keys() and all(np.allclose(got[i], want[i], rtol=1e-6) for i in want)
    assert want[500][0] == 2 and want[502][0] == 1


def test_tasks_of_scores_take_little_memory(monkeypatch):
    """A task that counts pairs, or reads texts with many frequent words, holds a few bytes a token and no copy of the head."""
    r = np.random.default_rng(5)
    words = np.array(["%x" % (x * 7919) for x in range(200_000)])
    texts = [" ".join(words[r.integers(0, len(words), 20_000)].tolist()) for _ in range(30)]
    batches = lambda name, column: [pa.RecordBatch.from_arrays([pa.array([t]), pa.array([column[i]])], ["text", name]) for i, t in enumerate(texts)]
    place = {w.encode(): i for i, w in enumerate(words[:100_000].tolist())}
    head = place, scoring.key_facts([scoring.spell(k) for k in place], np.ones(len(place), int)), np.full((len(place) + 1) * scoring.KINDS, -1, np.float32)
    monkeypatch.setattr(scoring, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    counted, pairs_mb = peak(lambda: sum(b.column("n").to_numpy().sum() for b in scoring._pairs({})(iter(batches("learn", [True] * 30)))))
    (n, rest), texts_mb = peak(lambda: np.sum([(b.column("n_tokens").to_numpy().sum(), len(b.column("rest").flatten())) for b in scoring._documents({}, SimpleNamespace(value=head))(iter(batches("doc_id", range(30))))], 0))
    apart = sum(len({w for w in t.split() if w.encode() not in place}) for t in texts)
    assert counted == n == 30 * 20_001 and rest == apart + 30  # the head has no end
    assert pairs_mb < 80 and texts_mb < 70, (pairs_mb, texts_mb)


def test_tasks_give_memory_back():
    """What a task has freed isn't kept by its process, which lives on as another task's worker."""
    code = """
import re, sys
import pyarrow as pa
from tally.llm import common, scoring
def taken():
    return sum(map(int, re.findall(r"Pss_Anon: +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024
texts = [" ".join("%x" % (i * 7919 + j * 104729) for j in range(20000)) for i in range(30)]
batches = lambda: (pa.RecordBatch.from_arrays([pa.array([t]), pa.array([True])], ["text", "learn"]) for t in texts)
first = taken()
for _ in getattr(common, "lean", lambda f: f)(scoring._pairs({}))(batches()):
    pass
print(taken() - first)
"""
    left = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout)
    assert left < 50, left


def test_beginnings_are_lengthened(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SHARED", 5)
    words = [b"ab%c%c " % (97 + i, 97 + j) for i in range(3) for j in range(1 + 3 * i)] + [b"a ", b"\n", b"xyz "]
    pairs = spark.createDataFrame([(w, 0, 2) for w in words], "spelled binary, kind int, n long")
    leaves, begun = scoring.beginnings(pairs)
    want = {w: next(b for b in (w[:2], w[:3], w[:4]) if sum(x.startswith(b) for x in words) <= 5 or b == w) for w in words}
    assert {bytes(r.spelled): bytes(r.begin) for r in begun.collect()} == want
    assert [b for b, _, _ in leaves] == sorted(set(want.values())) and sum(n for _, _, n in leaves) == 2 * len(words)


def test_languages(spark, docs, empty):
    en, de = "the and of tion ing with that".split(), "der und ung schaft mit dass ich".split()
    rows = []
    for i in range(160):
        words, lang = ((en, "en"), (de, "de"))[i % 2]
        rows.append((i, " ".join(R.choice(words) + R.choice(words) for _ in range(60)), lang))
    rows += [(1000, None, "en"), (1001, "123 !", "en"), (1002, "", None)]
    got = {r.doc_id: r for r in language.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    held = [r for r in rows[:160] if got[r[0]].held_out]
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got.values())
    assert language.languages(empty).count() == 0


def test_every_language_is_learned(spark):
    """More languages than a round number of them, the small ones too."""
    r = random.Random(6)
    names = [f"l{i:02d}" for i in range(70)]
    rows = []
    for i, name in enumerate(names):
        letters = [chr(0x4E00 + 64 * i + k) for k in range(20)]
        for _ in range(24 if i < 64 else 12):
            rows.append((len(rows), " ".join("".join(r.choice(letters) for _ in range(3)) for _ in range(30)), name))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(docs).languages == names
    got = {x.doc_id: x.lang_pred for x in language.languages(docs).collect()}
    small = [(got[i], lang) for i, _, lang in rows if lang >= "l64"]
    assert np.mean([a == b for a, b in small]) > 0.5


def test_pieces(spark, docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    model = pieces.PieceModel(piece_model_path())
    signs = [*"ab  \n\t▁éß€😀 <>s0x1", "<s>", "<0x0A>", " ⁇ ", "the", "naïve "]
    odd = ["".join(R.choice(signs) for _ in range(R.randrange(30))) for _ in range(300)] + ["a" * 300 + "é" * 90]
    for t in [*(t or "" for t in TEXTS), *odd]:
        ids, spans = model.encode(t)
        n, ids_sha, decoded_sha, covered = model.digest(t)
        want = lib.encode(t)
        assert ids == want and ids_sha == sha(",".join(map(str, want))) and n == len(want)
        assert model.decode(ids) == lib.decode(want) and decoded_sha == sha(lib.decode(want))
        assert covered == len(t.encode()) and (not spans or (spans[0][0] == 0 and spans[-1][1] == covered))
        assert all(a <= b for a, b in spans) and all(x[1] in (y[0], y[1]) for x, y in zip(spans, spans[1:], strict=False))
    got = {r.doc_id: r for r in pieces.piece_digests(docs, piece_model_path()).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, lib.encode(t or ""))).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(lib.encode(t or "")).encode()).hexdigest()
    assert pieces.piece_digests(empty, piece_model_path()).count() == 0
    back = pieces.decode_documents(pieces.encode_documents(docs.filter("doc_id = 11"), piece_model_path()), piece_model_path())
    assert back.first().text == TEXTS[11]


def test_pieces_of_a_model_with_a_character_map(tmp_path):
    """The same pieces with the library's nmt_nfkc rules: ids, decoded text and byte spans equal the library's."""
    import sentencepiece

    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", escape_whitespaces=True, add_dummy_prefix=True, remove_extra_whitespaces=True)
    path = tmp_path / "mapped.model"
    with open(piece_model_path(), "rb") as f:
        path.write_bytes(f.read() + rules.serialized_model_proto())
    lib, model = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.PieceModel(str(path))
    assert model.map.units and model.drop_extra and model.cut_source is None
    signs = [*"ab c  d\n\té😀▁  Ａ①ﬁ́ü ℌ…\x00日本", "the", " of", "un", "ﬀ", "㌔", "e\u0301"]
    for t in ["", " ", *("".join(R.choice(signs) for _ in range(R.randrange(40))) for _ in range(400)), "ﬁ " * 300]:
        ids, spans = model.encode(t)
        want = lib.encode(t, return_type="proto")
        assert ids == [x.id for x in want.pieces] and model.digest(t)[:3] == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
        # The library gives all bytes of a character but the last an empty span.
        told = [((x.begin, x.end), s) for x, s in zip(want.pieces, spans, strict=True) if x.end > x.begin]
        assert all(a == b for a, b in told)
    # The longest key wins, and what begins no key is left alone.
    assert model.map.longest("ﬁx".encode(), 0) == (3, "fi") and model.map.longest(b"x", 0) is None


def test_digests_come_from_spans_and_ids(monkeypatch):
    """A lost span shows in covered_bytes, and a changed id in the decoded text."""
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["naïve words € and more"])], ["doc_id", "text"])
    run = pieces._digests(piece_model_path())
    (whole,) = (b.to_pylist()[0] for b in run(iter([batch])))
    encode = pieces.PieceModel.encode
    monkeypatch.setattr(pieces.PieceModel, "encode", lambda self, t, first=True: tuple(x[:-1] for x in encode(self, t, first)))
    monkeypatch.setattr(pieces, "_LOADED", {})
    (less,) = (b.to_pylist()[0] for b in run(iter([batch])))
    assert whole["covered_bytes"] == len("naïve words € and more".encode()) > less["covered_bytes"]
    assert whole["decoded_sha256"] != less["decoded_sha256"] and whole["n_tokens"] == less["n_tokens"] + 5


def test_licenses(docs, empty):
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert got[13].labels == "mit" and got[14].labels == "apache" and got[13].score >= 0.9 and got[11].score == 0
    spans = licenses.license_spans(docs).filter("doc_id = 13").first()
    assert (spans.start, spans.stop) == (0, 5)
    assert licenses.license_scan(empty).count() == 0


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=6) * (1 + i % 4)], 0) for i in range(300)]
    rows += [(300, None, 0), (301, [1.0, None], 0), (302, [float("nan")] * 6, 0), (303, rows[0][1], 0), (304, rows[0][1], 0), (305, [1.0], 0), (306, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    whole = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    got = {}
    for x in top_k.top_k(df, df.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    for q in [i for i in whole if i % 20 == 0]:
        s = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)[:20]
        assert sorted(got[q]) == [(k + 1, i, -n) for k, (n, i) in enumerate(s)]
    assert top_k.top_k(df.limit(0), df.limit(0)).count() == 0


def test_words_of_long_texts(monkeypatch):
    import pyarrow as pa

    text = " ".join(sentence(50) for _ in range(20))
    whole = next(W.word_hashes(pa.array([text])))[1][0]
    monkeypatch.setattr(W, "CHUNK", 64)
    W._POWERS.clear()
    cut = next(W.word_hashes(pa.array([text])))[1][0]
    assert (whole == cut).all() and len(whole) == len(text.split())


def test_byte_bpe_is_the_library():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(byte_bpe_path()), tokens.ByteBpe(byte_bpe_path())
    signs = [*"ab  \n\t\r'sé€😀09!?", "\x1c", "\xa0", "<|endoftext|>", "'re", " "]
    for _ in range(400):
        t = "".join(R.choice(signs) for _ in range(R.randrange(40)))
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t
