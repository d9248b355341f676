"""Exact dedup, sharding and mixing: oracles, edge cases, laws."""

import random
import re
import zlib

import duckdb
import pytest
from llm_support import SF, edge_docs, no_docs, shipped, texts_of  # noqa: F401
from pyspark.sql import functions as F

from cadence.llm import exact_dedup, mixing, queries, sharding
from cadence.llm._common import sums_before


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(r) for r in got.select(*names).collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)


def test_native_queries_run_no_python(spark):
    for name in ("op7_mix_sources", "op8_rendezvous_shards", "op9_exact_dedup", "op12_url_filter"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ------------------------------------------------------------- exact dedup
def brute_groups(rows):
    groups = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep))
    return sorted(out, key=str)


def test_exact_groups_on_edge_rows(edge_docs):
    got = exact_dedup.exact_groups(edge_docs).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(texts_of(edge_docs))


def test_a_hash_collision_does_not_merge_texts(edge_docs):
    weak = lambda t: F.lit(b"same")
    got = exact_dedup.exact_groups(edge_docs, digest=weak).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(texts_of(edge_docs))


def test_exact_dedup_keeps_whole_rows(edge_docs, no_docs):
    kept = exact_dedup.exact_dedup(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 5, 6, 7, 8, 9]
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert exact_dedup.exact_groups(no_docs).count() == 0


# ---------------------------------------------------------------- sharding
def test_shards_on_edge_rows(edge_docs, no_docs):
    rows = sharding.shard_rows(edge_docs, [1.0] * 7).collect()
    assert len(rows) == edge_docs.count()
    texts = sorted(((t or "").encode() for _, t in texts_of(edge_docs)), key=len)
    assert sorted(r["size"] for r in rows) == [len(t) + 16 for t in texts]
    assert sorted(r["text_crc32"] for r in rows) == sorted(zlib.crc32(t) for t in texts)
    for s in range(7):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_rows(no_docs, [1.0] * 7).count() == 0


def test_slots_do_not_depend_on_the_number_of_ranges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = sharding.shard_rows(docs, [1.0] * 5).collect()
    b = sharding.shard_rows(docs, [1.0] * 5, rows_per_range=3).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_a_new_shard_takes_rows_only_into_itself_and_weights_hold(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    out = sharding.shard_rows(rows, [1.0, 1.0, 2.0])
    moved = out.filter("shard != grown_shard")
    assert moved.filter("grown_shard != 3").count() == 0
    sizes = {r["shard"]: r["count"] for r in out.groupBy("shard").count().collect()}
    assert abs(sizes[2] / 20_000 - 0.5) < 0.02 and abs(sizes[0] / 20_000 - 0.25) < 0.02
    assert abs(moved.count() / 20_000 - 2 / 6) < 0.02


# ------------------------------------------------------------------ mixing
def water_level(sizes, weights, most=3):
    """Targets by filling in small rounds (independent of the closed form)."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while True:
        rest = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / w > most * sizes[i]] if w else []
        for i in open_ if not over else over:
            target[i] = float(most * sizes[i]) if over else rest * weights[i] / w
        open_ -= set(over)
        if not over:
            return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 1000, 5], [0, 7, 0], [1, 1, 1, 1, 1000]])
def test_targets_match_the_filling_in_rounds(spark, sizes):
    rows = [(f"s{i}", s) for i, s in enumerate(sizes)]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, source_size bigint"), (5, 2, 1)).collect()
    want = water_level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [r["target"] for r in sorted(got, key=lambda r: r["source"])] == pytest.approx(want)


def test_mix_on_edge_rows(edge_docs, no_docs):
    rows = mixing.mix(edge_docs, (5, 2, 1)).collect()
    assert len(rows) == edge_docs.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert sum(r["size"] for r in own) == own[0]["source_size"]
    assert mixing.mix(no_docs, (5, 2, 1)).count() == 0


def test_mix_does_not_depend_on_the_number_of_ranges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = mixing.mix(docs, (5, 2, 1)).select("doc_id", "taken").collect()
    b = mixing.mix(docs, (5, 2, 1), rows_per_range=2).select("doc_id", "taken").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_heavier_documents_are_drawn_more_often(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source")
    )
    out = mixing.mix(rows, (3, 1), quality=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1))
    taken = {r["even"]: r["t"] for r in out.filter("source = 'b'").groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(F.sum("taken").alias("t")).collect()}
    assert taken[True] > 2.5 * taken[False]


def test_mixed_documents_are_whole_rows(spark, edge_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mixed_documents(docs, (5, 2, 1))
    assert mixed.columns == docs.columns
    assert mixed.join(docs, docs.columns, "left_anti").count() == 0
    words = mixed.groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n"))
    target = mixing.mix(docs, (5, 2, 1)).select("source", "target", "source_size").distinct()
    longest = docs.groupBy("source").agg(F.max(mixing.word_count("text")).alias("m"))
    for r in words.join(target, "source").join(longest, "source").collect():
        assert abs(r["n"] - r["target"]) <= r["m"]
    assert mixing.mixed_documents(edge_docs, (5, 2, 1)).columns == edge_docs.columns



def test_a_document_over_the_budget_takes_no_room_from_others(spark):
    """199 short documents and one far over the budget, wherever it is drawn."""
    rows = [(i, " ".join(["w"] * 10), "a") for i in range(199)] + [(999, " ".join(["w"] * 20_000), "a"), (1000, " ".join(["w"] * 5000), "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for seed in ("1", "2", "3", "4"):
        out = mixing.mix(docs, (1, 9), whole_documents=True, seed=seed).filter("source = 'a'").collect()
        target = out[0]["target"]
        got = sum(r["taken"] for r in out)
        assert 1990 < target < 21_990 and got == 1990  # all that fits: the rest is one document's size
    budget = mixing.mix(docs.filter("doc_id < 999 OR doc_id = 1000"), (1, 9), whole_documents=True).filter("source = 'a'")
    r = budget.selectExpr("sum(taken) AS got", "first(target) AS target").first()
    assert abs(r["got"] - r["target"]) <= 10


def test_many_sources_go_by_ranges(spark):
    rng = random.Random(6)
    sizes = [rng.choice([0, 1, 5, 40, 3000]) for _ in range(700)]
    rows = [(f"s{i:04}", s) for i, s in enumerate(sizes)]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, source_size bigint"), (5, 2, 1)).collect()
    want = water_level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [r["target"] for r in sorted(got, key=lambda r: r["source"])] == pytest.approx(want)


def test_sums_before(spark):
    rows = [(i, (i * 7919) % 1000) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, v bigint").repartition(5)
    got = {r["id"]: (r["s"], r["n"]) for r in sums_before(df, [F.col("v"), F.col("id")], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == {i: (sum(v for _, v in order[:k]), k) for k, (i, v) in enumerate(order)}
    assert sums_before(df.limit(0), [F.col("v")], {"s": F.col("v")}).count() == 0
