"""The registered queries of this subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alidade.llm.bpe import bpe_round_trip
from alidade.llm.common import table
from alidade.llm.exact_dedup import exact_dedup
from alidade.llm.html_text import extract_text
from alidade.llm.language_id import identify_languages, learn_languages
from alidade.llm.mixing import mix_sources
from alidade.llm.ngram_join import jaccard_components
from alidade.llm.quality_classifier import learn_quality, score_quality
from alidade.llm.quality_rules import judge_lines, learn_field
from alidade.llm.substring_dedup import remove_earlier_passages
from alidade.llm.suffix_dedup import remove_repeated_strings


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))  # a row without an id is in no fold
    return score_quality(docs, learn_quality(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_strings(table(spark, sf_dir, "documents"), window=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))  # a row without an id is in no fold
    return identify_languages(docs, learn_languages(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("content_sha256", "text_sha256")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_earlier_passages(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.expr("bigint(length(ids) / 4)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_lines(docs, learn_field(docs, table(spark, sf_dir, "labels"))).drop("content_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_ngram_join": op4_ngram_join,
    "op5_language_id": op5_language_id,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_html_text": op7_html_text,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality_rules": op10_quality_rules,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": """
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        chunks AS (SELECT doc_id, length(h) / 2 AS n, c, substring(h, 512 * c + 1, 910) AS part
                   FROM (SELECT doc_id, h, unnest(range(0, CAST(ceil(length(h) / 512) AS BIGINT))) AS c FROM t)),
        places AS (SELECT doc_id, n, c, part, unnest(range(1, CAST(least(256, n - 256 * c) AS BIGINT) + 1)) AS j FROM chunks),
        windows AS (
            SELECT doc_id, 256 * c + j AS i, substring(part, 2 * j - 1, 2) AS byte, n - 256 * c - j >= 199 AS whole,
                   CASE WHEN n - 256 * c - j >= 199 THEN md5(substring(part, 2 * j - 1, 400)) END AS w
            FROM places),
        hits AS (SELECT doc_id, i, byte, whole AND count(*) OVER (PARTITION BY w) > 1 AS hit FROM windows),
        covered AS (
            SELECT doc_id, i, byte, max(CAST(hit AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM hits),
        runs AS (SELECT *, gone - coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 1 AS begins FROM covered),
        sums AS (
            SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(CAST(begins AS INT)) AS BIGINT) AS n_spans,
                   coalesce(string_agg(byte, '' ORDER BY i) FILTER (gone = 0), '') AS kept
            FROM runs GROUP BY doc_id)
        SELECT t.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM t LEFT JOIN sums USING (doc_id)""",
    "op4_ngram_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x20\\x09-\\x0D]+') AS words
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
                                                WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g
            FROM w),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s >= 90 * (x.n + y.n - s)),
        reached AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a)
        SELECT r.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
        FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op8_substring_dedup": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        places AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
        windows AS (SELECT doc_id, i, words[i] AS word, md5(CASE WHEN len(words) - i >= 49 THEN array_to_string(words[i:i + 49], ' ') END) AS v FROM places),
        hits AS (SELECT doc_id, i, word, v IS NOT NULL AND min(doc_id) OVER (PARTITION BY v) < doc_id AS hit FROM windows),
        covered AS (
            SELECT doc_id, i, word, max(CAST(hit AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM hits),
        sums AS (
            SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept
            FROM covered GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN sums USING (doc_id)""",
    "op3_mix_sources": """
        WITH sized AS (
            SELECT doc_id, source,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                   -ln((CAST(('0x' || substr(md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) + 0.5::DOUBLE)
                       / 281474976710656.0::DOUBLE)
                   / greatest(0.05::DOUBLE, 1.0::DOUBLE
                       - 10.0::DOUBLE * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))
                         / greatest(length(coalesce(text, '')), 1)) AS key
            FROM documents),
        sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        ranked AS (
            SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, 2.0::DOUBLE * source_size AS cap,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
            FROM sizes),
        levels AS (
            SELECT *, cap / weight AS full_at,
                   1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
                   - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS rest,
                   CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (
                       ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS weights
            FROM ranked),
        level AS (
            SELECT rest / weights AS level FROM levels WHERE rest <= full_at * weights ORDER BY full_at, rank LIMIT 1),
        targets AS (
            SELECT source, source_size, coalesce(least(cap, (SELECT level FROM level) * weight), cap) AS target FROM levels),
        runs AS (
            SELECT s.*, t.source_size, t.target,
                   CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
                   CAST(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * (epochs + CASE WHEN run - size / 2.0::DOUBLE < target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM runs""",
    "op6_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(t) AS text_sha256
        FROM n""",
}
