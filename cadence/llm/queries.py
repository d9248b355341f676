"""Registered queries of this subpackage (``opN_<name>``) and their DuckDB SQL.

Every query applies its operator with production parameters to its whole
table and derives the digest columns of the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm import (
    embed_dedup,
    exact_dedup,
    html_extract,
    minhash,
    mixing,
    packing,
    periodic,
    pii,
    quality,
    sharding,
    substring_dedup,
    url_filter,
    whitening,
)
from cadence.llm._common import read_table

TOKENIZER = "word_bpe_49k.json"
SEQUENCE_LENGTH, END_ID = 2048, 1
N_SHARDS = 40
SOURCE_WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
# Fixed by the data contract: host, path, verdict.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(read_table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.quality_scores(docs, labels).drop("mark")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(
        read_table(spark, sf_dir, "documents"),
        public_tokenizers.path(TOKENIZER),
        capacity=SEQUENCE_LENGTH,
        end_id=END_ID,
    )


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mix(docs, SOURCE_WEIGHTS, max_epochs=MAX_EPOCHS).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return sharding.shard_rows(docs, [1.0] * N_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op10_nn_descent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"))


def planted_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """Numbers of the words that stand in a document of ``n`` words; None
    leaves it as it is (fixed by the data contract)."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    words = np.arange(n)
    words[a:] = a + (words[a:] - a) % p
    return words


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(read_table(spark, sf_dir, "documents"), rewrite=planted_words)
    ranked = F.transform(
        "runs",
        lambda r: F.struct(
            (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length")
        ),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.when(F.size("runs") > 0, F.array_max(ranked))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULES)
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), rules)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_personal_data": op4_personal_data,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_pack_sequences": op6_pack_sequences,
    "op7_mix_sources": op7_mix_sources,
    "op8_rendezvous_shards": op8_rendezvous_shards,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_nn_descent_dedup": op10_nn_descent_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_url_filter": op12_url_filter,
    "op13_embedding_whitening": op13_embedding_whitening,
}


def _h52(*parts: str) -> str:
    """The 52-bit MD5 integer of ``_common.hash52``."""
    text = " || ':' || ".join(parts)
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT)"


_ID = "coalesce(doc_id::VARCHAR, 'null')"
_WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT"


def _unit(h: str) -> str:
    return f"(({h}::DOUBLE + 0.5) / 4503599627370496.0)"


def _winner(n: int) -> str:
    return f"""(SELECT first(s ORDER BY -1.0 / ln({_unit(_h52(_ID, "s::VARCHAR"))}) DESC, s)
        FROM range({n}) r(s))::INT"""


# CRC-32 in SQL: the byte table follows from the reversed polynomial by rule.
_CRC_TABLE = """SELECT list(v ORDER BY i) AS tbl FROM (SELECT i, list_reduce([i::BIGINT] || range(8),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i))"""


def _crc32(text: str) -> str:
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return (
        f"xor(list_reduce([4294967295::BIGINT] || {data}, "
        "lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)"
    )


def mix_sql(docs: str) -> str:
    """Common table expressions that end in ``mixed`` (id, source, sizes, taken)."""
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(SOURCE_WEIGHTS))
    quality = r"""CASE WHEN length(coalesce(text, '')) = 0 THEN 1.0 ELSE greatest(0.0625,
        pow(length(regexp_replace(text, '[!-@\[-`{-~]', '', 'g'))::DOUBLE / length(text)::DOUBLE, 2)) END"""
    return rf"""
    raw AS (SELECT *, {_WORDS} AS size, -ln({_unit(_h52("'mix'", _ID))}) / least(1.0, {quality}) AS draw FROM {docs}),
    src AS (SELECT source, sum(size)::BIGINT AS source_size FROM raw GROUP BY source),
    weighed AS (SELECT *, {MAX_EPOCHS} * source_size AS cap,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(SOURCE_WEIGHTS)} {weights} END AS w FROM src),
    levels AS (SELECT *, sum(source_size) OVER () AS total,
        sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
        coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before
        FROM weighed),
    marked AS (SELECT *, cap * w_left <= w * (total - cap_before) AS capped FROM levels),
    targets AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
        w::DOUBLE * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE
        / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::DOUBLE END AS target FROM marked),
    epoched AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
    mixed AS (SELECT raw.*, source_size, target, epochs,
        round(target - epochs * source_size)::BIGINT - coalesce(sum(size) OVER (PARTITION BY raw.source ORDER BY draw, doc_id, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
        FROM raw JOIN epoched ON raw.source IS NOT DISTINCT FROM epoched.source)"""


_RULES_SQL = ", ".join(str(r) for r in URL_RULES)

ORACLES: dict[str, str] = {
    "op3_minhash_near_dedup": r"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN
            list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
        grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach(doc_id, c) AS (SELECT doc_id, doc_id FROM sets UNION
            SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.doc_id WHERE reach.c < links.b),
        parts AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN parts USING (doc_id)""",
    "op7_mix_sources": f"""WITH {mix_sql("documents")}
        SELECT doc_id, size, source_size, target,
               (epochs * size + greatest(0, least(size, room)))::BIGINT AS taken FROM mixed""",
    "op8_rendezvous_shards": f"""
        WITH crc AS ({_CRC_TABLE}),
        placed AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, {_crc32("coalesce(text, '')")} AS text_crc32,
            {_winner(N_SHARDS)} AS shard, {_winner(N_SHARDS + 1)} AS grown_shard,
            {_h52(_ID, "'slot'")} AS place FROM documents, crc)
        SELECT doc_id, size, text_crc32, shard, grown_shard, 'key' AS law,
               row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, size, text_crc32) - 1 AS slot FROM placed""",
    "op9_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t""",
    "op11_periodic_runs": f"""
        WITH crc AS ({_CRC_TABLE}),
        raw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
            {_crc32("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents, crc),
        placed AS (SELECT *, len(w) AS n, h // 10 AS g FROM raw),
        planted AS (SELECT *, doc_id IS NOT NULL AND h % 10 = 0 AND n > 0 AS yes, CASE WHEN n > 0 THEN g % n END AS a FROM placed),
        cut AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM planted),
        words AS (SELECT doc_id, r, n, i, w[1 + CASE WHEN yes AND i >= a THEN a + (i - a) % p ELSE i END] AS word
            FROM (SELECT *, unnest(range(n)) AS i FROM cut)),
        same AS (SELECT x.r, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        isles AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same),
        spans AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM isles GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
        runs AS (SELECT r, s, l, min(q) AS q FROM spans GROUP BY r, s, l),
        best AS (SELECT r, count(*) AS n_runs, arg_min({{'s': s, 'l': l, 'q': q}}, {{'e': -l::DOUBLE / q::DOUBLE, 's': s, 'q': q}}) AS b,
            string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
        gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT raw.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli,
            sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
        FROM raw LEFT JOIN best USING (r) LEFT JOIN kept USING (r)""",
    "op12_url_filter": f"""
        WITH rules(rh, rp, rv) AS (VALUES {_RULES_SQL}),
        rest AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM pages),
        parts AS (SELECT page_id, r, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        best AS (SELECT r, arg_max(rh || rp, {{'n': length(rh) + length(rp), 'h': length(rh)}}) AS rule,
            arg_max(rv, {{'n': length(rh) + length(rp), 'h': length(rh)}}) AS rv
            FROM parts, rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
        SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM parts LEFT JOIN best USING (r)""",
}
