"""Registered training-data queries and the corpus pipeline."""

import string
from collections import Counter

import pytest
from webtide.oracle.harness import compare, duck_connect

SF = "/root/testdata/sf0.01"


def test_names():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op4_collision_counting", "op8_line_dedup"])
def test_matches_sql(spark, name):
    from webtide.llm.queries import QUERIES, SQL

    r = compare(QUERIES[name](spark, SF), SQL[name], duck_connect(SF))
    assert r["ok"], r


def test_pipeline(spark):
    import corpus_pipeline
    from test_llm_operators import simhash_by_hand
    from webtide.llm.langid import identify_languages
    from webtide.llm.toxicity import score_toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "exact_dedup", "simhash_dedup", "packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.run(spark, SF)
    got = out.groupBy("doc_id").sum("length").collect()
    kept = {r.doc_id for r in got}
    rejected = {r.doc_id for r in identify_languages(docs).where("rejected").collect()}
    assert not kept & rejected
    left = docs.where(~docs.doc_id.isin(list(rejected))) if rejected else docs
    toxic = {r.doc_id for r in score_toxicity(left, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert toxic and not kept & toxic
    # exact copies: the largest id; near copies: the smallest of what is left
    last = {}
    for i, t in sorted(rows.items()):
        if i not in rejected | toxic:
            last[t.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))] = i
    near, _ = simhash_by_hand([(i, rows[i]) for i in sorted(last.values())])
    assert kept == {c for _, _, c in near}
    full = Counter(r.doc_id for r in out.select("doc_id", "doc_tokens").distinct().collect())
    assert set(full.values()) == {1}


def test_pipeline_on_awkward_tables(spark, tmp_path):
    import corpus_pipeline
    from test_llm_operators import SCHEMA, awkward_rows

    spark.createDataFrame([(4, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, rows in (("rows", awkward_rows()), ("none", [])):
        docs = spark.createDataFrame(rows, SCHEMA)
        columns = docs.columns
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{k}")
            docs.write.parquet(path)
            docs = f(spark, spark.read.parquet(path), str(tmp_path))
            assert stage == "packing" or docs.columns == columns
        assert (docs.count() > 0) == (name == "rows")
