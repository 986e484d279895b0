"""The stages, one after the other, against what is planted in a small corpus."""

import random

import corpus_pipeline
from tally.llm.queries import byte_bpe_path
from tokenizers import Tokenizer

R = random.Random(9)
WORDS = [f"{a}{b}" for a in "ba ke lo mi tu sa ri".split() for b in "ra ne so pi du lan".split()]


def sentence(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def test_pipeline(spark, tmp_path):
    base = sentence(200)
    texts = {i: sentence(R.randrange(5, 400)) for i in range(120)}
    for i in range(0, 120, 4):
        texts[i] += " you idiot, you moron. you scum."
    texts |= {200: base, 201: base, 202: base + " end", 203: "card 4845168114407329 of ann@host.org " + sentence(9), 204: "", 205: None}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        rows = docs.collect()
        seen.append({r.doc_id for r in rows})
        if name == "pii":
            final = {r.doc_id: r.text for r in rows}
            assert "4845168114407329" not in final[203] and "ann@host.org" not in final[203]
            assert all(r.n_chars == len(r.text or "") for r in rows)
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
    clean = {i for i in range(120) if i % 4}
    assert seen[0] == clean | {200, 201, 202, 203, 204, 205}
    assert seen[1] == clean | {200, 202, 203, 204}
    assert seen[2] == clean | {200, 203, 204}
    assert seen[3] == seen[4] == seen[2]
    t = Tokenizer.from_file(byte_bpe_path())
    assert sum(r.length for r in rows) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in final.values())
