"""The operators' queries over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.llm import audit, bpe, decontaminate, jaccard, linededup, media, pseudo, quality, streamdedup, suffix, trie, urltree, whitening

RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is in the held-out fold; one without an id is not (no label can name it, so nothing is learnt from it either)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_quality(docs: DataFrame, labels: DataFrame) -> quality.QualityModel:
    return quality.fit_quality(docs, labels.where(~held_out()))


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, learn_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def suffix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def media_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_column(table(spark, sf_dir, "documents"))


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"))


def lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"), keep_text=False)


def urls_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge_urls(table(spark, sf_dir, "pages"))


def pseudo_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo.score_pseudo(table(spark, sf_dir, "documents"))


def trie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamdedup.dedup_stream(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def whiten_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


LINES_SQL = f"""
WITH lines AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, p, array_to_string(l[p + 1:p + {linededup.WIDTH}], chr(10)) AS s
      FROM (SELECT doc_id, l, unnest(range(0, greatest(len(l) - {linededup.WIDTH - 1}, 0))) AS p FROM lines)),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w WHERE length(s) >= {linededup.WIDTH}),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + {linededup.WIDTH})))) AS g FROM ranked WHERE k > 1 GROUP BY doc_id),
out AS (SELECT doc_id, l, coalesce(g, []) AS g FROM lines LEFT JOIN gone USING (doc_id)),
kept AS (SELECT doc_id, l, g, coalesce(array_to_string(list_filter(list_transform(range(0, len(l)), lambda i: CASE WHEN list_contains(g, i) THEN NULL ELSE l[i + 1] END), lambda x: x IS NOT NULL), chr(10)), '') AS t FROM out)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(g) AS BIGINT) AS n_removed, sha256(t) AS kept_sha256 FROM kept
"""

DEDUP_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm, text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""

AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
said AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS fails FROM t LEFT JOIN said USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, CAST(sum(good) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, 1 << (ascii(filter_order[step]) - 65) AS bit, CAST(list_sum(list_transform(range(0, step), lambda k: CASE WHEN k = 0 THEN 0 ELSE 1 << (ascii(filter_order[k]) - 65) END)) AS INT) AS before FROM o, range(1, 6) r(step)),
j AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS removed, coalesce(sum(n) FILTER (fails & before <> 0 AND fails & bit <> 0), 0) AS redundant,
        coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM j
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe_query,
    "op2_decontaminate": decontaminate_query,
    "op3_quality": quality_query,
    "op4_suffix": suffix_query,
    "op5_media": media_query,
    "op6_jaccard": jaccard_query,
    "op7_lines": lines_query,
    "op8_urls": urls_query,
    "op9_pseudo": pseudo_query,
    "op10_trie": trie_query,
    "op11_stream": dedup_query,
    "op12_audit": audit_query,
    "op13_whiten": whiten_query,
}
ORACLES: dict[str, str] = {"op7_lines": LINES_SQL, "op11_stream": DEDUP_SQL, "op12_audit": AUDIT_SQL}
