"""The corpus pipeline stage by stage against plain versions, with nulls, empty texts, repeats and clashing names."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import pytest
from inkledger.llm import common, mixing, toxicity
from test_operators import SCHEMA, SF, jaccard, special


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder of tables: documents with odd rows, and labels."""
    at = str(tmp_path_factory.mktemp("pipeline"))
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "clash", "clash", "clash", 1) for r in documents.collect()]
    rows = base[:90] + special()
    rows += [rows[3], rows[-12], (None, base[0][1], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    schema = SCHEMA.replace("ver string, size string, rank_ string, keep_ int", "ver_ string, shard_ string, mixing_row__ string, pad_ int")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


def cut(rows, width=100):
    """Texts of (doc_id, text) without the bytes of repeated windows."""
    first = {}
    ordered = sorted({(d, t or "") for d, t in rows if d is not None}, key=lambda r: (r[0], common.crc(r[1].encode())))
    out = {}
    for d, t in ordered:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in first:
                gone[i : i + width] = b"\1" * width
            first.setdefault(w, d)
        out[d, t] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return Counter((d, None if t is None else t if d is None else out[d, t]) for d, t in rows)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_in_order(spark, sf):
    docs = before = common.read(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.write_table(stage(spark, before, sf), f"test-{name}")
        rows, kept = pairs(before), pairs(docs) if "text" in docs.columns else None
        if name != "sentencepiece":
            assert docs.columns == before.columns and docs.schema.simpleString() == before.schema.simpleString()
        if name == "toxicity":
            model = toxicity.fit(before, common.read(spark, sf, "labels"))
            match = model.matcher()
            assert Counter(kept) == Counter((d, t) for d, t in rows if model.score(*match.measure(t or "")) < toxicity.THRESHOLD)
            assert 5013 not in {d for d, _ in kept} and {5014, 5001, 5000} <= {d for d, _ in kept}
        if name == "jaccard":
            plain = [(d, t or "") for d, t in rows]
            group = jaccard(plain, 5, 80, 100)
            full = {k for k in plain if group[k][0]}
            assert Counter((d, t or "") for d, t in kept if (d, t or "") not in full) == Counter(k for k in plain if k not in full)
            leaders = Counter(group[d, t][1] for d, t in kept if (d, t or "") in full)
            assert leaders == dict.fromkeys({group[k][1] for k in full}, 1)
        if name == "suffix_dedup":
            assert Counter(kept) == cut(rows)
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None)
        if name == "mixing":
            drawn = Counter()
            for r in mixing.taken(before).collect():
                drawn[r.doc_id] += r.taken // r.size if r.size else 0
            assert Counter(d for d, _ in kept) == +drawn and set(kept) <= set(rows)
        if name == "sentencepiece":
            want = Counter((d, hashlib.sha256(re.sub("▁", " ", t or "").encode()).hexdigest()) for d, t in rows)
            assert Counter((r.doc_id, r.decoded_sha256) for r in docs.collect()) == want
        before = docs
    ran = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.decoded_sha256) for r in ran.collect()) == Counter((r.doc_id, r.decoded_sha256) for r in docs.collect())


def test_empty_table(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        common.read(spark, sf, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
