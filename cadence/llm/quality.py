"""Quality by hierarchical empirical Bayes: document evidence, host and path.

1.  One pass turns every text into a few counts (kinds of bytes, words,
    different words) and from these a short feature vector.
2.  A logistic regression on a bounded sample of labelled documents
    (``train_rows`` of them, by hash of the id; a documented parameter) gives
    every document's probability of being good: its own evidence.
3.  Grouped sums over all documents give, per host (``source``) and per path
    below it (``lang``), how good a site's documents are.  A host's rate is
    shrunk toward the global rate, a path's toward its host's, by weights that
    the method of moments finds from the spread between sites: sparse sites,
    and sites that differ no more than chance, follow their parent.
4.  A document's posterior adds the log-odds of its path (itself left out)
    over the global ones to its own evidence; it is kept from ``keep_from``.

Probabilities are summed as whole millionths, so reruns agree exactly.

Edge cases: a null or empty text has zero counts and is judged on these; a
null host or path is a site of its own; without labelled documents of both
kinds every document's evidence is neutral and all are kept; an id labelled
both good and bad counts as bad; rows that repeat a doc_id are judged by their
own text; a text of any length is one row (about 20 bytes of memory a word); an
empty table gives no rows; extra columns are ignored by ``quality_scores`` and
carried by ``keep_good``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm import textkernels as tk
from cadence.llm._common import free_names, named, text_or_empty
from cadence.plans.lineage import cut_lineage

TRAIN_ROWS = 20_000
KEEP_FROM = 0.5
RIDGE = 1e-3
LARGEST_WEIGHT = 1e6

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other mark, 6 space, 7 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _CLASS[_c] = 4 if _c in b".,;:'-" else 5
_CLASS[[32, 9, 10, 11, 12, 13]] = 6
_CLASS[128:] = 7
FEATURES = (
    "lower", "upper", "digit", "sentence_marks", "other_marks", "beyond_ascii", "word_length", "different_words",
    "commonest_word", "length", "marks_per_word", "upper_over_lower",
)


def text_features(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    n = len(borders) - 1
    counts = np.zeros((n, 8))
    for at in range(0, len(data), tk.SLICE_BYTES):  # the kinds of bytes, per document and slice
        part = _CLASS[data[at : at + tk.SLICE_BYTES]]
        first, last = np.searchsorted(borders, at, "right") - 1, np.searchsorted(borders, at + len(part), "left")
        sizes = np.diff(np.clip(borders[first : last + 1], at, at + len(part)))
        each = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes) * 8 + part
        counts[first:last] += np.bincount(each, minlength=8 * len(sizes)).reshape(-1, 8)
    words, at = tk.word_hashes(data, borders)
    total = np.diff(at).astype(float)
    different, commonest = np.zeros(n), np.zeros(n)
    for i in np.flatnonzero(total).tolist():
        _, c = np.unique(words[at[i] : at[i + 1]], return_counts=True)
        different[i], commonest[i] = len(c), c.max()
    solid = np.maximum(1.0, np.diff(borders) - counts[:, 6])
    many = np.maximum(1.0, total)
    return np.column_stack(
        [
            counts[:, 1] / solid, counts[:, 2] / solid, counts[:, 3] / solid, counts[:, 4] / solid, counts[:, 5] / solid,
            counts[:, 7] / solid, np.minimum(solid / many, 40) / 10, different / many ** 0.8, commonest / many,
            np.log1p(total), np.minimum(counts[:, 5] / many, 3), np.minimum(counts[:, 2] / np.maximum(1, counts[:, 1]), 3),
        ]
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in tk.text_blocks(batches, 4):
        x = text_features(*tk.text_bytes(block.column(4)))
        offsets = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*(block.column(i) for i in range(4)), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))],
            ["id", "mark", "host", "path", "x"],
        )


def _widened(x: np.ndarray) -> np.ndarray:
    """Constant, features, and their squares (a kind of bad text may show in a
    value that is too high or too low)."""
    return np.column_stack([np.ones(len(x)), x, x * x])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and scales of a ridge logistic regression (Newton)."""
    wide = _widened(x)
    mean, scale = wide.mean(0), wide.std(0)
    mean[0], scale[0] = 0.0, 1.0
    scale[scale == 0] = 1.0
    z = (wide - mean) / scale
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge * len(y))
    penalty[0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def _evidence(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(4).flatten(), float).reshape(batch.num_rows, len(FEATURES))
            if model is None:
                logit = np.zeros(len(x))
            else:
                w, mean, scale = model
                logit = np.clip(((_widened(x) - mean) / scale) @ w, -12, 12)
            good = np.rint(1e6 / (1 + np.exp(-logit))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(good)], ["id", "mark", "host", "path", "good"]
            )

    return run


def _moment_weight(sites: DataFrame, parent: str) -> float:
    """Prior weight of a level: how many documents the parent's rate is worth,
    from the spread of the sites' rates beyond sampling."""
    rate = F.col("good") / F.col("n") / 1e6
    row = sites.filter("n > 1").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * (rate - F.col(parent)) ** 2).alias("spread"),
        F.sum(F.col(parent) * (1 - F.col(parent))).alias("chance"),
        F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))).alias("mass"),
    ).first()
    if not row["k"] or not row["mass"]:
        return LARGEST_WEIGHT
    beyond = (row["spread"] - row["chance"]) / row["n"]
    if beyond <= 0:
        return LARGEST_WEIGHT
    return float(min(LARGEST_WEIGHT, max(1.0, row["mass"] / row["n"] / beyond - 1)))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
    keep_from: float = KEEP_FROM,
) -> DataFrame:
    """Per row: id, ``mark`` (hash of the text), ``p_document``, ``host_rate``,
    ``path_rate``, ``p_good`` and ``kept``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    site = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("null"))
    slim = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), site(host_col).alias("host"), site(path_col).alias("path"), text.alias("text")
    )
    schema = f"id {id_type}, mark bigint, host string, path string"
    measured = cut_lineage(slim.mapInArrow(_features, f"{schema}, x array<double>"), "table")
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.groupBy("id").agg(F.min("y").alias("y")).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(2**40)))
    # the share of the labels that the sample needs, so that the tasks together
    # send little more than the sample to the driver
    share = min(1.0, 1.1 * train_rows / max(1, known.count()))
    sample = (
        measured.join(known.filter(F.col("h") < int(share * 2**40)), "id")
        .select("id", "mark", "x", "y", "h")
        .orderBy("h", "id", "mark")
        .limit(train_rows)
        .collect()
    )
    y = np.array([r["y"] for r in sample], float)
    model = fit_logistic(np.array([r["x"] for r in sample]), y) if len(y) and 0 < y.mean() < 1 else None
    scored = cut_lineage(measured.mapInArrow(_evidence(model), f"{schema}, good bigint"), "table")
    paths = scored.groupBy("host", "path").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n"))
    paths = cut_lineage(paths, "table")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("good"), F.sum("n")).first()
    if not total[1]:
        total = (500_000, 1)
    overall = min(1 - 1e-6, max(1e-6, total[0] / total[1] / 1e6))
    host_weight = _moment_weight(hosts.withColumn("parent", F.lit(overall)), "parent")
    rate = lambda good, n, parent, weight: (good / 1e6 + parent * F.lit(weight)) / (n + F.lit(weight))
    hosts = hosts.select(
        "host", F.col("good").alias("host_good"), F.col("n").alias("host_n"),
        rate(F.col("good"), F.col("n"), F.lit(overall), host_weight).alias("host_rate"),
    )
    sites = cut_lineage(paths.join(hosts, "host"), "table")  # a plain scan: Spark can split the join on a large site
    path_weight = _moment_weight(sites, "host_rate")
    clip = lambda p: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    odds = lambda p: F.log(p / (1 - p))
    rows = scored.withColumnRenamed("good", "own").join(sites, ["host", "path"])
    others_host = rate(F.col("host_good") - F.col("own"), F.col("host_n") - 1, F.lit(overall), host_weight)
    others_path = rate(F.col("good") - F.col("own"), F.col("n") - 1, others_host, path_weight)
    p = clip(F.col("own") / F.lit(1e6))
    posterior = odds(p) + odds(clip(others_path)) - F.lit(float(np.log(overall / (1 - overall))))
    keep = F.lit(True) if model is None else F.col("p_good") >= keep_from
    return (
        rows.withColumn("p_document", F.col("own") / F.lit(1e6))
        .withColumn("path_rate", others_path)
        .withColumn("p_good", 1 / (1 + F.exp(-posterior)))
        .select(F.col("id").alias(id_col), "mark", "p_document", "host_rate", "path_rate", "p_good", keep.alias("kept"))
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the rejected documents, all columns as they came."""
    scores = quality_scores(docs, labels, id_col, text_col, **params)
    out_id, out_mark = free_names(docs, "out_id", "out_mark")
    out = scores.filter(~F.col("kept")).select(named(scores, id_col).alias(out_id), F.col("mark").alias(out_mark)).distinct()
    same = named(docs, id_col).eqNullSafe(F.col(out_id)) & (F.xxhash64(text_or_empty(named(docs, text_col))) == F.col(out_mark))
    return docs.join(out, same, "left_anti")
