"""MinHash groups, repeated passages and vectors against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_support import SF, edge_docs, no_docs, shipped, texts_of  # noqa: F401

from cadence.llm import bwt, embed_dedup, minhash, substring_dedup
from cadence.llm import textkernels as tk
from cadence.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def union_find(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# -------------------------------------------------------------- components
def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (5, None)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges] + edges[:40]
    got = [tuple(r) for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()]
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert len(got) == len(dict(got))
    assert dict(got) == union_find({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


# ----------------------------------------------------------------- MinHash
def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_near(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    inverted, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    for ids in inverted.values():
        common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    pairs = [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    return {i: (len(sets[i]), c) for i, c in union_find(sets, pairs).items()}


@pytest.mark.parametrize("block", [256, 3])
def test_near_groups_match_brute_force(spark, block):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(docs, block_docs=block).collect()}
    want = brute_near(texts_of(docs))
    assert {i: v[:2] for i, v in got.items()} == want
    assert all(v[2] == (i == v[1]) for i, v in got.items())


def test_a_large_group_of_near_copies_across_blocks(spark):
    """Copies of one text with changes: some just linked, some just not."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), block_docs=10).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute_near(rows)


def test_similarity_exactly_at_the_limit(spark):
    """15 shared of 20 shingles is linked, 11 of 15 is not."""
    words = [f"w{i}" for i in range(100)]
    a, b = " ".join(words[:21]), " ".join(words[2:24])  # 17 and 18 shingles
    assert len(shingles(a) & shingles(b)) * 100 == 75 * len(shingles(a) | shingles(b))
    c, d = " ".join(words[40:57]), " ".join(words[42:59])
    assert (len(shingles(c) & shingles(d)), len(shingles(c) | shingles(d))) == (11, 15)
    rows = [(1, a), (2, b), (3, c), (4, d)]
    got = {r[0]: r[2] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == got[2] == 1 and (got[3], got[4]) == (3, 4)


def test_near_groups_on_edge_rows(edge_docs, no_docs):
    got = minhash.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    want = brute_near([(i, t) for i, t in texts_of(edge_docs) if i is not None])
    assert {r[0]: (r[1], r[2]) for r in got if r[0] is not None} == want
    assert all(r["component_id"] is None and not r["kept"] for r in got if r[0] is None)
    assert minhash.near_duplicates(no_docs).count() == 0
    kept = minhash.near_dedup(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 8]


def test_kernels_on_sliced_columns():
    import pyarrow as pa

    texts = pa.array(["é a", None, "", "B b\tB", "x" * 70]).slice(1)
    data, borders = tk.text_bytes(texts)
    assert data.tobytes() == b"B b\tB" + b"x" * 70 and borders.tolist() == [0, 0, 0, 5, 75]
    words, at = tk.word_hashes(data, borders)
    assert at.tolist() == [0, 0, 0, 3, 4] and len(set(words.tolist())) == 2


# ------------------------------------------------------- repeated passages
def brute_repeats(rows, window=50):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        for k in range(len(b) - window + 1):
            first.setdefault(b[k : k + window], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            least = first[b[k : k + window]]
            if least is not None and (i is None or least < i):
                gone[k : k + window] = b"\1" * window
        spans = len(re.findall(b"\1+", bytes(gone)))
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot, chunk", [(4096, 1 << 22), (1, 3000)])
def test_repeats_match_brute_force(spark, hot, chunk):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = substring_dedup.remove_repeats(docs, hot_anchor=hot, chunk_bytes=chunk).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(texts_of(docs))


def test_repeats_on_edge_rows(edge_docs, no_docs):
    got = substring_dedup.remove_repeats(edge_docs, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute_repeats(texts_of(edge_docs))
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_repeats_in_periodic_and_sliced_texts(spark, monkeypatch):
    rng = random.Random(3)
    word = "".join(rng.choice("abc") for _ in range(200))
    texts = ["ab" * 100, "ab" * 30 + word, word[20:120] + "ab" * 40, "é" * 60, "xé" + "é" * 40, word * 3, "a" * 49, "a" * 50, "a" * 51]
    rows = list(enumerate(texts * 2))
    rng.shuffle(rows)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows)
    data, borders = tk.text_bytes(__import__("pyarrow").array(t for _, t in rows))
    whole = substring_dedup.anchor_runs(data, borders, 50)
    monkeypatch.setattr(substring_dedup, "SLICE", 64)
    cut = substring_dedup.anchor_runs(data, borders, 50)
    spread = lambda r: sorted((s + i, int(a)) for s, n, a in zip(*(x.tolist() for x in r)) for i in range(n))
    assert spread(whole) == spread(cut)


def test_interval_expansion_gives_common_prefixes():
    rng = random.Random(4)
    for _ in range(60):
        text = np.array([rng.randint(1, 3) for _ in range(rng.randint(2, 60))] + [0], np.int16)
        order = bwt.suffix_order(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: tuple(text[i:]))
        lcp, _ = bwt.expand_intervals(bwt.transform(text, order), 6)
        for i in range(1, len(text)):
            a, b = text[order[i - 1] :], text[order[i] :]
            n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert lcp[i] == min(n, 6)


def test_equal_windows_are_grouped():
    rng = random.Random(5)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 8))]
        n = rng.randint(1, 8)
        owner, start, group = bwt.equal_windows(strings, n)
        seen = defaultdict(set)
        for o, s, g in zip(owner, start, group):
            seen[g].add(strings[o][s : s + n])
        assert all(len(v) == 1 for v in seen.values())
        assert len(seen) == len({s[i : i + n] for s in strings for i in range(len(s) - n + 1)})


# ----------------------------------------------------------------- vectors
def brute_vectors(rows, threshold=0.9):
    ok = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            scaled = np.array(v, float) / np.abs(np.array(v, float)).max()  # no under- or overflow
            ok[k] = scaled / np.linalg.norm(scaled)
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold]
    degree = Counter(x for p in links for x in p)
    part = union_find({i for i, _ in rows if i is not None}, [(rows[a][0], rows[b][0]) for a, b in links])
    return sorted(((i, degree[k], part.get(i), i is not None and part[i] == i) for k, (i, _) in enumerate(rows)), key=str)


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((6, 16))
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(150)]
    rows += [(1000 + i, (centres[i % 6] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(180)]
    rows += [(2000 + i, centres[0].tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = embed_dedup.near_vectors(df, cell=16).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute_vectors(rows)
    assert got[0]["audited_recall"] == 1.0


def test_vectors_on_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.1]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
        (8, [1.0, None]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [0.0, 1.0]), (11, [1e-300, 0.0]), (12, [1e300, 1e299]),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, digest string, id int")
    got = embed_dedup.near_vectors(df).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute_vectors(rows)
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_vectors_of_the_driver_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = embed_dedup.near_vectors(df).collect()
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute_vectors(rows)


def family(rng, centre, n, spread):
    out = centre + spread * rng.standard_normal((n, len(centre)))
    return (out / np.linalg.norm(out, axis=1)[:, None]).tolist()


def test_tight_families_linked_with_each_other(spark):
    """Lists full of the own family hide the links to the others."""
    rng = np.random.default_rng(4)
    a, b = np.eye(16)[:2]
    c = 0.93 * a + (1 - 0.93**2) ** 0.5 * b
    vectors = [v for x in (a, c, -a, -c) for v in family(rng, x, 14, 0.005)] + rng.standard_normal((60, 16)).tolist()
    rows = list(enumerate(vectors))
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), cell=32).collect()
    want = brute_vectors(rows)
    assert sorted((tuple(r)[:4] for r in got), key=str) == want
    assert {r[2] for r in want if r[0] < 56} == {0, 28}


def test_audit_sees_missed_pairs_beside_a_large_component(spark):
    rng = np.random.default_rng(8)
    vectors = np.array(family(rng, np.eye(32)[0], 300, 0.001))
    for centre in rng.standard_normal((40, 32)):
        vectors = np.concatenate([vectors, family(rng, centre / np.linalg.norm(centre), 2, 0.001)])
    rows = [(i, 32, v.tobytes(), 1) for i, v in enumerate(vectors)]
    vertices = spark.createDataFrame(rows, "id bigint, dim int, unit binary, copies bigint")
    lists = spark.createDataFrame([], embed_dedup.EDGES)
    # the family's links are found, those of 30 of the 40 pairs are not
    links = [(i, 0, 299) if i < 300 else (i, i, 0) if i < 360 else (i, i - i % 2, 1) for i in range(380)]
    found = spark.createDataFrame(links, "id bigint, component bigint, n bigint")
    assert embed_dedup._recall(vertices, found, lists, 400, 0.9) == pytest.approx(0.25)
    none = spark.createDataFrame([(i, i, 0) for i in range(380)], "id bigint, component bigint, n bigint")
    assert embed_dedup._recall(vertices, none, lists, 400, 0.9) == 0.0


def test_effort_follows_the_table_and_a_missed_goal_raises(spark, monkeypatch):
    p = lambda n, cuts: 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** embed_dedup.cell_bits(n, 192)) ** cuts
    for n in (10, 10**4, 10**6, 10**8):
        assert p(n, embed_dedup.cuts_for(n, 192, 0.9, 0.97)) >= 0.97
    monkeypatch.setattr(embed_dedup, "_recall", lambda *a: 0.5)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id bigint, embedding array<double>")
    with pytest.raises(RuntimeError, match="recall"):
        embed_dedup.near_vectors(df, attempts=1)


def test_vectors_of_two_lengths(spark):
    rng = np.random.default_rng(12)
    rows = []
    for dim, first in ((2, 0), (4, 1000), (7, 2000)):
        centres = rng.standard_normal((5, dim))
        rows += [(first + i, (centres[i % 5] + 0.2 * rng.standard_normal(dim)).tolist()) for i in range(45)]
    rng.shuffle(rows)
    rows = [(int(i), [float(x) for x in v]) for i, v in rows]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), cell=16).collect()
    want = brute_vectors(rows)
    assert sorted((tuple(r)[:4] for r in got), key=str) == want
    assert all(any(r[1] for r in want if lo <= r[0] < lo + 1000) for lo in (0, 1000, 2000))


def test_the_audit_of_unlinked_vectors_does_not_grow(spark, monkeypatch):
    seen = []
    counts = embed_dedup._audit_counts
    monkeypatch.setattr(embed_dedup, "_audit_counts", lambda sample, *a: seen.append(len(sample)) or counts(sample, *a))
    for n in (300, 900):
        v = np.random.default_rng(n).standard_normal((n, 32))
        v /= np.linalg.norm(v, axis=1)[:, None]
        vertices = spark.createDataFrame([(i, 32, x.tobytes(), 1) for i, x in enumerate(v)], "id bigint, dim int, unit binary, copies bigint")
        alone = spark.createDataFrame([(i, i, 0) for i in range(n)], "id bigint, component bigint, n bigint")
        lists = spark.createDataFrame([(i, (i + 1) % n, float(i) / n, False) for i in range(n)], embed_dedup.EDGES)
        seen.clear()
        assert embed_dedup._recall(vertices, alone, lists, 50, 0.9) == 1.0
        assert 70 <= sum(seen) <= 130


def test_a_missed_link_next_to_the_threshold_is_audited(spark):
    """One missed pair among 2,000 unlinked vertices: its lists came nearest."""
    v = np.random.default_rng(5).standard_normal((2000, 32))
    v[77] = v[1234] + 0.01
    v /= np.linalg.norm(v, axis=1)[:, None]
    vertices = spark.createDataFrame([(i, 32, x.tobytes(), 1) for i, x in enumerate(v)], "id bigint, dim int, unit binary, copies bigint")
    alone = spark.createDataFrame([(i, i, 0) for i in range(2000)], "id bigint, component bigint, n bigint")
    lists = spark.createDataFrame([(i, 0, 0.89 if i == 77 else 0.3, False) for i in range(2000)], embed_dedup.EDGES)
    assert embed_dedup._recall(vertices, alone, lists, 10, 0.9) == 0.0


@pytest.mark.parametrize("kernel", ["shingle_sets", "text_features"])
def test_memory_of_the_text_kernels(kernel):
    """Per byte of text: a text of 64 MB, and a block of 4 MiB of short ones."""
    import tracemalloc

    from cadence.llm import quality

    run = {"shingle_sets": tk.shingle_sets, "text_features": quality.text_features}[kernel]
    chunk = " ".join(f"word{i % 5003}" for i in range(100_000)).encode()
    long = np.frombuffer((chunk + b" ") * (64_000_000 // len(chunk)), np.uint8)
    for data, borders, limit in (
        (long, np.array([0, len(long)]), 7 * len(long)),
        (long[: 4 << 20], np.arange(0, (4 << 20) + 1, 2048), 24 << 20),
    ):
        tracemalloc.start()
        run(data, borders)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < limit, (peak, limit)


@pytest.mark.parametrize("slice_bytes", [1 << 18, 64, 7])
def test_slices_do_not_change_hashes(monkeypatch, slice_bytes):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice([" ", "\n", "a", "b", "Zz", "é", "word", "."]) for _ in range(rng.randrange(0, 120)))
    texts = [rng.choice([None, "", text(), "x" * rng.randrange(300)]) for _ in range(200)]
    data, borders = tk.text_bytes(pa.array(texts))
    words, at = tk.word_hashes(data, borders)
    sets = tk.shingle_sets(data, borders)
    one = {}
    for r, t in enumerate(texts):
        split = (t or "").lower().replace("\n", " ").split(" ")
        split = [w for w in split if w]
        assert at[r + 1] - at[r] == len(split)
        for w, h in zip(split, words[at[r] : at[r + 1]].tolist()):
            assert one.setdefault(w, h) == h
        assert len(sets[r]) == len(shingles(t))
    assert len(set(one.values())) == len(one)
    monkeypatch.setattr(tk, "SLICE_BYTES", slice_bytes)
    again, at2 = tk.word_hashes(data, borders)
    assert (again == words).all() and (at2 == at).all()
