"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Native DataFrame operations only.  A source's target is its weight's share of
all words, at most ``max_epochs`` times its own size; what a capped source
cannot take is reshared by weight until none is above its cap (the water level
in closed form: sources in the order of cap / weight, prefix sums over that
small table).  A source first gives every document as many whole times as its
target allows (complete epochs); the rest of the target is filled by weighted
sampling without replacement: each document draws ``-ln(u) / quality`` with
``u`` from a hash of its id, documents are sorted by that key inside the
source, and a prefix sum of their sizes runs up to the budget.

The sort and prefix sum of a source are cut into key ranges, so a source with
a third of all rows is spread over many tasks: rows are summed inside a range
and the totals of earlier ranges (one number per range) are added.  Quality
weights lie in [1/16, 1], hence keys are a mixture of exponentials with these
rates; the ranges are equal steps of the mean of such distribution functions,
which bounds a range's load whatever the weights are.

Edge cases: a null or wordless text has size 0 and takes 0; a null source is a
source of its own, last in order; rows that repeat a doc_id share its draw and
are ordered by size; an empty table gives no rows; sources without words get
target 0; a text of any length is counted where it lies; extra columns are
ignored by ``mix`` and carried by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm._common import WORD_PATTERN, free_names, group_count, hash52, named, sums_before, text_or_empty, unit_interval
from cadence.plans.lineage import cut_lineage

MIN_QUALITY = 0.0625
RATES = (1.0, 0.5, 0.25, 0.125, 0.0625)
ROWS_PER_RANGE = 100_000
RANGES_PER_SHARE = 3  # ranges for as many rows as one should hold: a range holds at most len(RATES) even shares


def word_count(col: str | Column) -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD_PATTERN)).cast("bigint")


def text_quality(col: str | Column) -> Column:
    """Share of characters that are neither ASCII punctuation nor digits,
    squared, between ``MIN_QUALITY`` and 1 (1 for an empty text)."""
    text = text_or_empty(col)
    plain = F.length(F.regexp_replace(text, r"[!-@\[-`{-~]", "")).cast("double")
    share = plain / F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(MIN_QUALITY), share * share))


def source_targets(sources: DataFrame, weights: Sequence[int], max_epochs: int = 3) -> DataFrame:
    """``sources`` (one row per source: ``source``, ``source_size``) with
    ``target``.  Numbers and prefix sums go by ranges of sources."""
    by_name = [F.col("source").isNull(), F.col("source")]
    t = sums_before(sources, by_name, {"number": F.lit(1)})
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    t = t.withColumn("w", w.cast("bigint")).withColumn("cap", F.col("source_size") * max_epochs)
    by_level = [F.col("cap") / F.col("w"), *by_name]
    t = cut_lineage(sums_before(t, by_level, {"w_before": F.col("w"), "cap_before": F.col("cap")}), "table")
    total, w_all = t.agg(F.sum("source_size"), F.sum("w")).first()
    left = F.lit(w_all or 0) - F.col("w_before")
    t = t.withColumn("capped", F.col("cap") * left <= F.col("w") * (F.lit(total or 0) - F.col("cap_before")))
    open_ = ~F.col("capped")
    w_open, cap_sum = t.agg(F.sum(F.when(open_, F.col("w"))), F.sum(F.when(F.col("capped"), F.col("cap")))).first()
    level = F.col("w").cast("double") * F.lit(float((total or 0) - (cap_sum or 0))) / F.lit(float(w_open or 1))
    return t.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level))


def mix(
    docs: DataFrame,
    weights: Sequence[int],
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    max_epochs: int = 3,
    whole_documents: bool = False,
    seed: str = "mix",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Id, source, ``size``, ``source_size``, ``target``, ``taken`` and
    ``mark`` (hash of the text) per row.

    The document in which a budget ends gives only the words still missing.
    With ``whole_documents`` a document larger than the whole budget is passed
    over (it takes no room from others), and the one in which the budget ends is
    taken whole if at least half of it fits.
    ``weights`` go to the sources in code point order, repeating; ``quality``
    is a weight expression, clipped to [1/16, 1].
    """
    spark = docs.sparkSession
    q = F.least(F.lit(1.0), F.greatest(F.lit(MIN_QUALITY), quality if quality is not None else text_quality(text_col)))
    rows = cut_lineage(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text_col).alias("size"),
            (-F.log(unit_interval(hash52(seed, F.col(id_col)))) / q).alias("draw"),
            F.xxhash64(text_or_empty(text_col)).alias("mark"),
        ),
        "table",
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    total = rows.count()
    per_range = total / group_count(total, rows_per_range, spark, per_partition=1) if total else 1
    targets = (
        source_targets(sources, weights, max_epochs)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint"))
        .withColumn("ranges", F.ceil(F.col("n") * RANGES_PER_SHARE / F.lit(float(per_range))))
        .select(
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("src"),
            "source_size", "target", "epochs", "rest", "ranges",
        )
    )
    targets = cut_lineage(targets, "table")  # a plain scan: Spark can split the join on a large source
    spread = sum((F.lit(1.0) - F.exp(F.col("draw") * F.lit(-r)) for r in RATES), F.lit(0.0)) / F.lit(float(len(RATES)))
    placed = (
        rows.withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
        .join(targets, "src")
        .withColumn("range", F.least(F.floor(spread * F.col("ranges")), F.col("ranges") - 1))
        .repartition("src", "range")
    )
    fits = F.col("size") <= F.col("rest") if whole_documents else F.lit(True)
    fitting = F.when(fits, F.col("size")).otherwise(0)
    earlier = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("src", "range")
        .agg(F.sum(fitting).alias("words"))
        .select("src", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("src", "range").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("words_before", F.coalesce(F.sum(fitting).over(inside), F.lit(0))).join(starts, ["src", "range"])
    room = F.col("rest") - F.col("start") - F.col("words_before")
    part = F.when(fits & (room * 2 >= F.col("size")), F.col("size")).otherwise(0) if whole_documents else F.greatest(F.lit(0), F.least(F.col("size"), room))
    return summed.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"),
        "mark",
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int], id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The mix as rows of ``docs``: each document as often as it is taken
    (whole documents), all columns as they came.  Only ids and hashes go
    through the sampling; texts move once, to the join with the decisions.
    Rows that repeat both id and text are taken equally often."""
    taken = mix(docs, weights, id_col, text_col, whole_documents=True, **params).filter("taken > 0")
    own_id, own_mark, copies, copy = free_names(docs, "own_id", "own_mark", "copies", "copy")
    times = taken.groupBy(named(taken, id_col).alias(own_id), F.col("mark").alias(own_mark)).agg(
        F.max((F.col("taken") / F.col("size")).cast("int")).alias(copies)
    )
    same = named(docs, id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_or_empty(named(docs, text_col))) == F.col(own_mark))
    each = F.explode(F.sequence(F.lit(1), F.col(copies)))
    return docs.join(times, same).withColumn(copy, each).select(*[F.col(f"`{c}`") for c in docs.columns])
