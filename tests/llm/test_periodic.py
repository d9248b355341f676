"""Periodic runs against brute force on all periods, and edge rows."""

import random
import re

import numpy as np
import pytest
from llm_support import SF, edge_docs, no_docs, shipped, texts_of  # noqa: F401

from cadence.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, min_length=6, min_exponent=4):
    found = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("limits", [(6, 4), (1, 3), (9, 5)])
def test_runs_of_random_words(limits):
    rng = random.Random(5)
    for _ in range(300):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            letters, words = rng.choice([1, 2, 3, 5]), []
            for _ in range(rng.randrange(0, 8)):
                words += [rng.randrange(letters) for _ in range(rng.randrange(1, 9))] * rng.choice([1, 1, 2, 4, 7])
            docs.append(words)
        names = np.array([w for d in docs for w in d], np.int64)
        doc, s, length, q = periodic.periodic_runs(names, np.cumsum([0] + [len(d) for d in docs]), *limits)
        for r, words in enumerate(docs):
            got = [tuple(x) for x in np.column_stack([s, length, q])[doc == r].tolist()]
            assert got == brute_runs(words, *limits)


def test_a_period_whose_factors_return_inside_it():
    """Short stretches return nearer than the period; no piece is proposed twice."""
    words = list("aabaabb" * 500) + list("xyz") + list("ab" * 3000)
    names = np.array([ord(c) for c in words])
    _, s, length, q = periodic.periodic_runs(names, np.array([0, len(names)]))
    assert (0, 3500, 7) in list(zip(s.tolist(), length.tolist(), q.tolist()))
    assert (3503, 6000, 2) in list(zip(s.tolist(), length.tolist(), q.tolist()))


def test_query_against_brute_force(spark):
    docs = {i: WORD.findall(t or "") for i, t in texts_of(spark.read.parquet(f"{SF}/documents.parquet"))}
    got = queries.op11_periodic_runs(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        words = docs[r["doc_id"]]
        picks = queries.planted_words(r["doc_id"], len(words))
        words = words if picks is None else [words[k] for k in picks]
        runs = brute_runs(words)
        assert r["n_runs"] == len(runs)
        if runs:
            s, length, q = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (s, length, q, 1000 * length // q)
        else:
            assert r["start"] is r["length"] is r["period"] is r["exponent_milli"] is None


def test_edge_rows(spark, edge_docs, no_docs):
    extra = [(20, "a b " * 9 + "c", "en", "a", 1), (21, " x" * 7, "en", "a", 1), (22, "x x x x x", "en", "a", 1), (None, "y " * 6, None, None, 1)]
    docs = edge_docs.select(*no_docs.columns).union(spark.createDataFrame(extra, no_docs.schema))
    got = sorted((str(r["doc_id"]), str([tuple(x) for x in r["runs"]]), r["collapsed"]) for r in periodic.find_runs(docs).collect())
    want = []
    for i, t in texts_of(docs):
        words = WORD.findall(t or "")
        runs = brute_runs(words) if len(words) < 100 else []
        want.append((str(i), str(runs), brute_collapsed(words, runs)))
    assert got == sorted(want)
    assert periodic.find_runs(no_docs).count() == 0
    assert periodic.find_runs(edge_docs).columns == ["doc_id", "runs", "collapsed"]
    with pytest.raises(ValueError):
        periodic.find_runs(docs, min_exponent=2)


def test_a_rewrite_stands_for_the_words(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e f")], "doc_id bigint, text string")
    twice = lambda i, n: np.arange(n) % 1 if i == 1 else None
    got = {r["doc_id"]: r["collapsed"] for r in periodic.find_runs(docs, min_length=3, rewrite=twice).collect()}
    assert got == {1: "a", 2: "e f"}
