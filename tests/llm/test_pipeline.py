"""The corpus pipeline against plain Python on the smallest tables."""

import re
from collections import Counter

import corpus_pipeline
from llm_support import SF, edge_docs, no_docs, shipped, texts_of  # noqa: F401
from test_near import brute_near
from test_text import check_packing

import __spark_entry__ as E
from cadence.llm import mixing, quality


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert 4 <= len(stages) <= 5

    good = stages["quality_classifier"](spark, docs, SF)
    scores = quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert good.columns == columns
    assert {r[0] for r in good.select("doc_id").collect()} == {r["doc_id"] for r in scores.filter("kept").collect()}

    single = stages["exact_dedup"](spark, good, SF)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for i, t in sorted(texts_of(good)):
        first.setdefault(norm(t), i)
    assert single.columns == columns and {r[0] for r in single.select("doc_id").collect()} == set(first.values())

    near = stages["near_dedup"](spark, single, SF)
    want = {i for i, (_, c) in brute_near(texts_of(single)).items() if i == c}
    assert near.columns == columns and {r[0] for r in near.select("doc_id").collect()} == want

    mixed = stages["mix_sources"](spark, near, SF)
    taken = mixing.mix(near, (5, 2, 1), whole_documents=True).collect()
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in taken if r["taken"]}
    assert mixed.columns == columns
    assert Counter(r[0] for r in mixed.select("doc_id").collect()) == Counter(copies)

    packed = stages["pack_sequences"](spark, mixed, SF).collect()
    check_packing(packed, texts_of(mixed), 2048)


def test_run_and_registration(spark):
    assert E.queries()["pipeline"] is corpus_pipeline.run
    packed = corpus_pipeline.run(spark, SF)
    assert packed.count() > 0
    for n in range(1, 14):
        assert len([q for q in E.queries() if q.startswith(f"op{n}_")]) == 1


def test_stages_on_edge_rows_and_on_nothing(spark, edge_docs, no_docs):
    """Nulls, empty and long texts, repeated rows: no stage crashes or changes
    the columns, and each keeps what its rule says."""
    docs = edge_docs.select(*no_docs.columns)
    least = {"quality_classifier": 1, "exact_dedup": 7, "near_dedup": 6, "mix_sources": 1}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert least[name] <= out.count() <= 3 * docs.count(), name
        assert stage(spark, no_docs, SF).count() == 0, name
        # columns of any name come through with their values
        wide = stage(spark, edge_docs, SF)
        assert wide.columns == edge_docs.columns, name
        assert wide.distinct().exceptAll(edge_docs.distinct()).count() == 0 and wide.count() >= least[name], name
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, edge_docs, SF).count() == pack(spark, docs, SF).count()
    assert pack(spark, docs, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert pack(spark, no_docs, SF).count() == 0
