"""The operators as registered queries: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import table
from . import decontamination, exact_dedup, filter_audit, hard_negatives, lm_scoring, packing, pii, secrets, sharding, simhash, substring_dedup, token_files, toxicity


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_documents(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_packing, op3_toxicity, op4_token_files, op5_lm_scoring, op6_exact_dedup, op7_decontamination, op8_secrets, op9_sharding, op10_simhash, op11_hard_negatives, op12_substring_dedup, op13_filter_audit)}

#: DuckDB SQL for those that SQL can express.
ORACLES: dict[str, str] = {
    "op6_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
                   FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id) = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM n""",
    "op11_hard_negatives": r"""
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
              FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 3""",
    "op12_substring_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2 * (256 + 49)) AS h FROM d, unnest(range(0, length(h) // 2, 256)) AS u(o)),
        w AS (SELECT doc_id, o + p AS p, md5(substr(h, 2 * p + 1, 100)) AS s FROM c, unnest(range(greatest(length(h) // 2 - 49, 0))) AS u(p)),
        m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
        r AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step FROM w JOIN m USING (s) WHERE least < doc_id),
        i AS (SELECT doc_id, p, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r),
        e AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY ALL),
        k AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS prior FROM e),
        g AS (SELECT doc_id, string_agg(substr(h, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY run) AS head, max(b) AS last, sum(b - a) AS gone, count(*) AS spans
              FROM k JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
               sha256(unhex(concat(head, substr(h, 2 * coalesce(last, 0) + 1)))) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        f AS (SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
                     100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
                     regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e FROM w),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
                     count(*) AS n, count_if(coalesce(good, false)) AS good, count_if(coalesce(toxic, false)) AS toxic
              FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
        o AS (SELECT concat(p.k, q.k, r.k, s.k, t.k) AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
        g AS (SELECT filter_order, step, filter_order[step:step] AS letter, filter_order[1:step - 1] AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
        s AS (SELECT *, contains(fails, letter) AS failed, len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) = 0 OR fails = '' OR earlier = '' AS reached FROM g, m),
        c AS (SELECT part, filter_order, step::INTEGER AS step, letter,
                     coalesce(sum(n) FILTER (WHERE reached AND NOT failed), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE reached AND failed), 0)::BIGINT AS removed,
                     coalesce(sum(n) FILTER (WHERE NOT reached AND failed), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = letter), 0)::BIGINT AS unique_fails,
                     coalesce(sum(good) FILTER (WHERE reached AND failed), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE reached AND failed), 0)::BIGINT AS toxic_lost
              FROM s GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM c""",
}
