"""Personal data: base patterns, and bootstrapped contextual extraction.

The base patterns (email, ip, card, phone) give the seed entities.  Every
maximal identifier-like run outside the base matches (four digits or an inner
``@``; ASCII letters and digits with the separators of the base patterns,
blanks between groups of digits included) is an instance, and so is every seed.
The words beside an instance, which may be or hold base matches, are its lexical
patterns: the word before, the two words before, and the words on both sides.
Words end at white space and at the marks of records (quotes, brackets, commas,
semicolons, ``=``, ``&``, ``|``); ideographs and kana are words of their own.  They
are looked for in the ``BEFORE`` characters before an instance and the ``AFTER``
behind it, so a longer word counts by its end (its beginning): that keeps the
patterns' size, and the search, in proportion to the text.

Spark scores the bipartite graph of patterns and instances in rounds.  A
pattern's confidence for a kind is the mass of its instances known to be of
that kind over the mass of all its different instances and ``prior`` unknown ones.
Instances known to be of another kind speak against it in full, unseen ones only
with the weight ``unlabelled``, and the less the more they score themselves: a
context may hold as many unseen instances as known ones and still be sure.  A
pattern counts from ``support`` known instances on.  An unseen instance's score is
the noisy-or of its confident patterns.  Instances are different texts, so a
frequent one counts once per pattern.  After the last round unseen instances
at or above ``accept`` become spans of that kind wherever a confident pattern
stands beside them.

One pass over the texts writes base spans and the few instances of each
document; everything after it works on these.

Edge cases: a null text counts as empty and has no spans; an empty table gives
no rows; rows that repeat a doc_id are searched one by one; extra columns are
ignored; the searches are linear in the text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm._common import text_or_empty
from cadence.plans.lineage import cut_lineage

BEFORE, AFTER = 100, 50
KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 5.0
PRIOR = 1.0
UNLABELLED = 0.25
CONFIDENT = 0.8
ACCEPT = 0.8

# Fixed by the contract.  The lookbehind only skips starts that cannot match
# when the run's first digit did not; emails are found from their @.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
# groups of hexadecimal digits between colons, or a run of identifier characters
_RUN = re.compile(
    r"(?<![A-Za-z0-9:])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){2,}(?![A-Za-z0-9:])"
    r"|(?:[A-Za-z0-9._%+@-]|\([0-9]++\)|(?<=[0-9])/(?=[0-9])|(?<=[0-9)])\x20(?=\(?[0-9]))++"
)
_LONE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[{_LONE}]|[^\s{_LONE}\"'`<>()\[\]{{}},;=&|、。，；：「」（）]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    found = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def _unseen(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Maximal identifier-like runs outside the base spans."""
    if "@" not in text and not _DIGIT.search(text):
        return
    at = 0
    for s, e in [*sorted((s, e) for _, s, e in spans), (len(text), len(text))]:
        for m in _RUN.finditer(text, at, max(at, s)):
            run = m[0].rstrip(" .%")
            core = run.lstrip(" .%")
            inner = core.find("@")
            if 0 < inner < len(core) - 1 or len(core) >= 4 and len(_DIGIT.findall(core)) >= 4:
                yield m.start() + len(run) - len(core), m.start() + len(run)
        at = max(at, e)


def _contexts(text: str, start: int, end: int) -> list[str]:
    before = _WORD.findall(text[max(0, start - BEFORE) : start].lower())
    after = _WORD.findall(text[end : end + AFTER].lower())
    one = before[-1] if before else "^"
    two = " ".join(before[-2:]) if before else "^"
    return list(dict.fromkeys([f"1 {one}", f"2 {two}", f"3 {one} _ {after[0] if after else '$'}"]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())])
    instance = pa.struct(
        [("kind", pa.int32()), ("s", pa.int64()), ("e", pa.int64()), ("word", pa.string()), ("patterns", pa.list_(pa.string()))]
    )
    for batch in batches:
        spans, instances = [], []
        for value in batch.column(2):
            text = value.as_py()
            own = base_spans(text)
            spans.append([{"k": k, "s": s, "e": e} for k, s, e in own])
            rows = [(k, s, e) for k, s, e in own] + [(None, s, e) for s, e in _unseen(text, own)]
            instances.append(
                [{"kind": k, "s": s, "e": e, "word": text[s:e], "patterns": _contexts(text, s, e)} for k, s, e in rows]
            )
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, pa.list_(span)), pa.array(instances, pa.list_(instance))],
            ["id", "mark", "spans", "instances"],
        )


SCAN = (
    "mark bigint, spans array<struct<k:int,s:bigint,e:bigint>>, "
    "instances array<struct<kind:int,s:bigint,e:bigint,word:string,patterns:array<string>>>"
)


def score_graph(
    links: DataFrame, rounds: int, support: float, prior: float, confident: float, unlabelled: float = UNLABELLED
) -> tuple[DataFrame, DataFrame]:
    """``links``: word, kind (null: unseen), pattern.  Returns the confident
    patterns (pattern, kind, confidence) and the unseen words (word, kind,
    score)."""
    edges = cut_lineage(links.groupBy("pattern", "word").agg(F.max("kind").alias("kind")), "table")
    counts = edges.groupBy("pattern").agg(F.count("kind").alias("known"), (F.count(F.lit(1)) - F.count("kind")).alias("unseen"))
    seeds = edges.filter("kind IS NOT NULL").select("pattern", "word", "kind", F.lit(1.0).alias("score"))
    unseen = edges.filter("kind IS NULL").select("pattern", "word")
    mass, sure = seeds, None
    for _ in range(rounds):
        against = F.col("known") + F.lit(unlabelled) * F.col("unseen")
        sizes = counts.withColumn("n", against.cast("double"))
        if sure is not None:  # an unseen instance that scores s counts as s known ones and 1 - s unlabelled ones
            more = F.lit(1 - unlabelled) * F.coalesce("sure", F.lit(0.0))
            sizes = counts.join(sure, "pattern", "left").withColumn("n", against + more)
        sizes = sizes.select("pattern", "n")
        known = mass.groupBy("pattern", "kind").agg(F.sum("score").alias("mass")).filter(F.col("mass") >= support)
        patterns = cut_lineage(
            known.join(sizes, "pattern")
            .select("pattern", "kind", (F.col("mass") / (F.col("n") + F.lit(prior))).alias("confidence"))
            .filter(F.col("confidence") >= confident),
            "table",
        )
        # noisy-or over an instance's patterns; 1e-9 keeps the logarithm finite
        scores = cut_lineage(
            unseen.join(patterns, "pattern").groupBy("word", "kind")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score")),
            "table",
        )
        mass = seeds.union(unseen.join(scores, "word").select("pattern", "word", "kind", "score"))
        best = scores.groupBy("word").agg(F.max("score").alias("score"))
        sure = unseen.join(best, "word").groupBy("pattern").agg(F.sum("score").alias("sure"))
    return patterns, scores


def _joined(spans) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(spans)
    return F.array_join(
        F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
    support: float = SUPPORT,
    prior: float = PRIOR,
    confident: float = CONFIDENT,
    accept: float = ACCEPT,
) -> DataFrame:
    """Per document: counts of the base kinds, ``base_sha256``, ``spans`` (base
    and discovered) and ``n_discovered``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    scanned = cut_lineage(slim.mapInArrow(_scan, f"id {id_type}, {SCAN}"), "table")
    found = scanned.select("id", "mark", F.explode("instances").alias("x")).select("id", "mark", "x.*")
    links = found.select("word", "kind", F.explode("patterns").alias("pattern"))
    patterns, scores = score_graph(links, rounds, support, prior, confident)
    accepted = scores.filter(F.col("score") >= accept)
    best = accepted.groupBy("word").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
    best = cut_lineage(best.select("word", (-F.col("b.k")).alias("found_kind")), "table")
    new = (
        found.filter("kind IS NULL")
        .join(best, "word")
        .select("id", "mark", "s", "e", "found_kind", F.explode("patterns").alias("pattern"))
        .join(patterns.select("pattern", F.col("kind").alias("found_kind")), ["pattern", "found_kind"], "left_semi")
        .groupBy("id", "mark")
        .agg(F.collect_set(F.struct(F.col("found_kind").cast("int").alias("k"), "s", "e")).alias("more"))
        .select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "more")
    )
    out = scanned.join(new, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    of_kind = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("bigint")
    both = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more"))
    return out.select(
        F.col("id").alias(id_col),
        *[of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_joined(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        _joined(both).alias("spans"),
        F.when(F.col("more").isNull(), 0).otherwise(F.size("more")).cast("bigint").alias("n_discovered"),
    )
