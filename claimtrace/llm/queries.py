"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimtrace.llm import host_quality, importance, media, mixing, pieces, secrets, shard, simhash, token_count, toxicity
from claimtrace.llm.common import table, whole

SEED = 20240229
#: Of the documents labelled as good, so many at most stand for the target of the quality classifier.
TARGET_ROWS = 20_000


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    drawn = pieces.sampled_segmentations(docs, path, k=4, seed=SEED, keep=["doc_id"])
    return drawn.select("doc_id", "sample", "n_pieces", "log_prob", "log_inclusion", "exact", "pieces")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, training = _documents(spark, sf_dir), toxicity.Training()
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), training)
    rows = toxicity.scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", toxicity.held_out(training.folds).alias("held_out"), "score", "predicted")


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.octet_length(whole()).cast("long") + 8
    rows = docs.select("doc_id", size.alias("size"), F.crc32(whole().cast("binary")).alias("text_crc32"))
    sharded = shard.shuffled_shards(rows, shards=24, seed=SEED)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(_documents(spark, sf_dir), weights=[1, 2, 3], most=3)
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.with_components(_documents(spark, sf_dir), width=4, distance=4)
    return grouped.select("doc_id", "fingerprint", F.col("component").alias("component_id"))


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
    first = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS).withColumn("_good", F.lit(True))
    marked = docs.join(F.broadcast(first), "doc_id", "left")
    return importance.resampled(marked, F.col("_good"), share=0.85, seed=SEED)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(_documents(spark, sf_dir))


def op8_mjpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.octet_length(whole()).cast("long").alias("n_bytes"))
    films = media.stored_and_read(docs)
    return films.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        media.feature(F.col("clips")).alias("feature"),
    )


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = host_quality.judged(_documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_poor", "host_rejected")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_count.with_token_counts(_documents(spark, sf_dir), path, limit=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_sampling": op1_sentencepiece_sampling,
    "op2_toxicity": op2_toxicity,
    "op3_feistel_shards": op3_feistel_shards,
    "op4_mixing": op4_mixing,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_importance_resampling": op6_importance_resampling,
    "op7_secret_scan": op7_secret_scan,
    "op8_mjpeg_media": op8_mjpeg_media,
    "op9_host_quality": op9_host_quality,
    "op10_token_counts": op10_token_counts,
}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _spans_sql(kind: str, number: int, regex: str, group: int, least: int) -> str:
    regex = regex.replace("'", "''")
    return f"""SELECT doc_id, {number} AS k, '{kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
        'a': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
        'n': length(m[i]), 'g': length(g[i])}}), lambda s: s.g >= {least})) AS s FROM
        (SELECT doc_id, regexp_extract_all(t, '{regex}') AS m, regexp_extract_all(t, '{regex}', {group}) AS g, string_split_regex(t, '{regex}') AS p
         FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d WHERE regexp_matches(t, '{regex}')) x"""


#: In SQL budgets are met by a running sum over the sorted hash line. ``op4_mixing`` finds the same thresholds, unless two
#: documents of a source share the upper 36 bits of their hashes at the very threshold.
ORACLE_SQL: dict[str, str] = {
    "op4_mixing": r"""
        WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
            CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS place FROM documents),
        g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
        w AS (SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM g),
        q AS (SELECT *, CAST(most AS DOUBLE) / weight AS ratio FROM w),
        o AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS r,
            (SELECT sum(source_size) FROM g) - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
            (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shared FROM q),
        l AS (SELECT arg_min(CAST(rest AS DOUBLE) / CAST(shared AS DOUBLE), r) AS level FROM o WHERE rest * weight <= most * shared),
        a AS (SELECT source, source_size, least(CAST(most AS DOUBLE), level * CAST(weight AS DOUBLE)) AS target FROM o, l),
        b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM a),
        c AS (SELECT *, CAST(round(target - copies * source_size) AS BIGINT) AS budget FROM b),
        d AS (SELECT s.doc_id, s.size, s.place, s.source, c.source_size, c.target, c.copies, c.budget,
            sum(size) OVER (PARTITION BY s.source ORDER BY place) AS upto, sum(size) OVER (PARTITION BY s.source, place) AS words
            FROM s JOIN c ON s.source IS NOT DISTINCT FROM c.source),
        e AS (SELECT *, min(CASE WHEN upto - budget > budget - (upto - words) THEN place END) OVER (PARTITION BY source) AS ending FROM d)
        SELECT doc_id, size, source_size, target, size * least(copies + CASE WHEN ending IS NULL OR place < ending THEN 1 ELSE 0 END, 3) AS taken, source,
            least(copies + CASE WHEN ending IS NULL OR place < ending THEN 1 ELSE 0 END, 3) AS copies FROM e""",
    "op7_secret_scan": f"""
        WITH every AS ({" UNION ALL ".join(_spans_sql(r.kind, k, r.java, r.group, r.least) for k, r in enumerate(secrets.RULES))}),
        found AS (SELECT doc_id, k, CAST(s.a AS BIGINT) AS a, kind || ':' || CAST(s.a AS BIGINT) || ':' || CAST(s.a + s.n AS BIGINT) AS span FROM every),
        listed AS (SELECT doc_id, string_agg(span, ',' ORDER BY a, k) AS spans, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1,
            count(*) FILTER (WHERE k = 2) AS n2 FROM found GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256,
            coalesce(spans, '') AS spans FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id""",
    "op9_host_quality": rf"""
        WITH u AS (SELECT doc_id, unnest({WORDS_SQL}) AS w, generate_subscripts({WORDS_SQL}, 1) AS i FROM documents),
        v AS (SELECT doc_id, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        c AS (SELECT doc_id, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS again FROM v),
        r AS (SELECT doc_id, sum(hit) AS n_repeat_words FROM (SELECT doc_id, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM c) x GROUP BY doc_id),
        n AS (SELECT doc_id, source, CAST(len({WORDS_SQL}) AS BIGINT) AS n_words, CAST(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
        m AS (SELECT n.doc_id, source, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
            CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM n LEFT JOIN r ON n.doc_id = r.doc_id),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS soft FROM m),
        h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed OR soft) AS DOUBLE) AS x FROM f GROUP BY source),
        t AS (SELECT sum(n) AS sn, sum(x) / sum(n) AS mean, sum(n * n) AS nn, sum(x * x / n) AS xx, count(*) AS hosts FROM h),
        e AS (SELECT mean, sn, xx - sn * mean * mean AS spread, mean * (1 - mean) * (hosts - 1) AS chance, mean * (1 - mean) * (sn - nn / sn - (hosts - 1)) AS unit FROM t),
        p AS (SELECT mean, least(1e6, greatest(1.0, 1 / greatest(CASE WHEN unit > 0 THEN (spread - chance) / unit ELSE 0 END, 1e-6) - 1)) AS weight FROM e),
        b AS (SELECT source, rate FROM (SELECT source, mean, weight, (x + mean * weight) / (n + weight) AS rate FROM h, p) y WHERE rate * 100 > 60 OR rate > mean + 2.33 * sqrt(mean * (1 - mean) / (weight + 1)))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR bad OR poor AND soft) AS kept, poor AS host_poor, bad AS host_rejected
        FROM (SELECT *, EXISTS (SELECT 1 FROM b WHERE b.source IS NOT DISTINCT FROM f.source) AS poor,
            EXISTS (SELECT 1 FROM b WHERE b.source IS NOT DISTINCT FROM f.source AND rate * 100 > 60) AS bad FROM f) z""",
}
