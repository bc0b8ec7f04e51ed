"""The stages against their operators' brute-force versions, and the rows they must keep."""

import corpus_pipeline as C
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runstore.llm import mixing, queries, secrets
from .test_near_duplicates import brute
from .test_packing_and_mixing import brute_mix, unpacked

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in C.STAGES:
        after = stage(spark, docs, SF).persist()
        out.append((name, docs, after))
        docs = after
    return {name: (before.collect(), after.collect(), after.columns) for name, before, after in out}


def test_order():
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]


def test_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(stages[n][2] == columns for n, _ in C.STAGES[:-1])


def test_quality_keeps_clean_documents(spark, stages):
    before, after, _ = stages["quality"]
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    judged = [(r.doc_id in kept, marks[r.doc_id]) for r in before if r.doc_id in marks]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.95 and 0 < len(after) < len(before)
    assert {r.doc_id: r for r in before if r.doc_id in kept} == {r.doc_id: r for r in after}


def test_near_duplicates_keep_one_of_each(stages):
    before, after, _ = stages["near_duplicates"]
    want = {i for i, (_, _, kept) in brute([(r.doc_id, r.text) for r in before]).items() if kept}
    assert {r.doc_id for r in after} == want and len(after) == len(want)


def test_secrets_are_masked(stages):
    before, after, _ = stages["secrets"]
    old, model = {r.doc_id: r for r in before}, secrets.tagger()
    assert len(before) == len(after)
    for r in after:
        text = old[r.doc_id].text
        if not secrets.base_spans(text) and not model.spans(pa.array([text])):
            assert r == old[r.doc_id]
        for _, a, b in secrets.base_spans(text):
            assert text[a:b] not in r.text
        assert r.n_chars == len(r.text)


def test_mixing_follows_the_weights(spark, stages):
    before, after, _ = stages["mixing"]
    df = spark.createDataFrame([(r.doc_id, r.lang, r.source, r.text) for r in before], "doc_id long, lang string, source string, text string")
    rows = [(r.doc_id, (r.domain, r.lang, r.source), r.n) for r in df.select("doc_id", *[c.alias(n) for n, c in queries.levels().items()], F.regexp_count("text", F.lit(mixing.WORDS)).alias("n")).collect()]
    want = brute_mix(rows, queries.WEIGHTS, round(C.MIX_SHARE * sum(n for _, _, n in rows)), 9, 1)
    assert sorted([(r.doc_id, 0) for r in after], key=str) == want


def test_packing_holds_every_token(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after, _ = stages["packing"]
    assert unpacked(after, [(r.doc_id, r.text) for r in before], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))) < 0.05


def test_run_is_the_stages(spark, stages):
    got = C.run(spark, SF).collect()
    assert sorted(map(tuple, ((r.doc_id, r.start, r.length, r.ids_crc32) for r in got))) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in stages["packing"][1])


def test_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_nulls_and_odd_rows_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "other", 0), (10**6 + 2, "word " * 3000, "xx", "src1", None)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        assert name == "packing" or docs.columns == odd.columns
    assert docs.count() > 0
