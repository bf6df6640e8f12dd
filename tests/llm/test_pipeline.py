"""The pipeline's stages against each other and against brute force, and the registered corpus queries on the smallest tables."""

import re

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_fingerprint, brute_measures, brute_spans

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "redact", "tokenize"]
    after = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, tiny).write.parquet(path)
        docs = spark.read.parquet(path)
        after[name] = {r["doc_id"]: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns
    for i, t in rows.items():  # what fails the fixed rules is gone
        n, *_, rep = brute_measures(t)
        if n < 50 or 100 * rep > 50 * n:
            assert i not in after["quality_rules"]
    left = {i: brute_fingerprint(rows[i]) for i in after["quality_rules"]}
    kept = set(after["near_dedup"])
    for i, f in left.items():  # a document goes only if a smaller one of its component stays
        assert i in kept or any((f ^ left[j]).bit_count() <= 2 for j in left if j != i)
    assert not any((left[i] ^ left[j]).bit_count() <= 2 for i in kept for j in kept if i < j)
    bench = [r["text"] for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    flat = lambda s: " ".join(s.split())
    assert not any(flat(b) in flat(r["text"]) for r in after["decontaminate"].values() for b in bench)
    assert set(after["redact"]) == set(after["decontaminate"]) == set(after["tokenize"])
    assert not any(brute_spans(re.sub(r"\[(?:EMAIL|IP|CARD|PHONE|ID)\]", " ", r["text"])) for r in after["redact"].values())
    assert all(r["round_trip"] for r in after["tokenize"].values())


def test_stages_on_odd_rows(spark, tiny, tmp_path):
    """Null and repeated ids, null and empty texts, clashing columns and an empty table, through every stage."""
    first = spark.read.parquet(f"{tiny}/documents.parquet").limit(60)
    text = {r["doc_id"]: r["text"] for r in first.collect()}
    odd = [(1, None), (1, ""), (None, text[0]), (None, None), (1, text[1]), (1, text[1])]
    extra = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    rows = first.unionByName(extra)
    for c in ("row", "model", "id", "fp", "_id", "_hash", "d", "t", "n", "kept", "spans"):
        rows = rows.withColumn(c, F.lit("clash"))
    for docs in (rows, rows.limit(0)):
        full = docs.count()
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            alone = stage(spark, docs, tiny)
            n = alone.count()
            assert n <= full and (full == 0 or n > 0)
            assert alone.columns == docs.columns if k < 4 else n == full
            if k < 4 and full:
                assert alone.filter("row <> 'clash' OR spans <> 'clash'").isEmpty()
    again = {}
    docs = rows
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / f"odd-{name}")
        stage(spark, docs, tiny).write.parquet(path)
        docs = spark.read.parquet(path)
        again[name] = docs.count()
    assert 0 < again["tokenize"] == again["redact"] == again["decontaminate"] <= again["near_dedup"] <= again["quality_rules"] < 66


def test_texts_are_shuffled_once(spark, tiny):
    """Only near_dedup exchanges rows; quality_rules exchanges partial aggregates by model alone."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        plan = stage(spark, docs, tiny)._jdf.queryExecution().executedPlan().toString()
        keys = set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan))
        assert keys <= {"model"} or name == "near_dedup", (name, keys)


def test_registered(spark, tiny):
    from srcloom.llm import queries

    q = queries.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in q) == list(range(1, 11))
    for name, f in q.items():
        assert f(spark, tiny).count() > 0, name
