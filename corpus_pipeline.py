"""The corpus pipeline: from raw documents to token ids, each stage on all that the one before kept.

A row is known by its id and 96 bits of hashes of id and text, so rows that share an id are told apart.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alidade.llm.bpe import bpe_round_trip
from alidade.llm.common import if_small, saved, settled, table
from alidade.llm.exact_dedup import exact_dedup
from alidade.llm.mixing import mix_sources
from alidade.llm.ngram_join import jaccard_components
from alidade.llm.quality_classifier import learn_quality, score_quality

_MARKS = ("_a", "_b")


def _marked(docs: DataFrame) -> DataFrame:
    """The documents as `row`, so that their other columns clash with nothing, what the operators read, and what tells rows apart: _a and _b, and the id `_row` of both and doc_id."""
    both = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "doc_id", "text", "source", F.xxhash64("doc_id", "text").alias("_a"), F.hash("text", "doc_id").alias("_b"))
    return both.withColumn("_row", F.struct("doc_id", *_MARKS))


def _keys(rows: DataFrame) -> DataFrame:
    """Rows with the marks of their column _row in its place."""
    return rows.select(*(F.col("_row")[m].alias(m) for m in _MARKS), *(c for c in rows.columns if c != "_row"))


def _once(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The marked docs, but of rows that found has several times (equal in id and text) only one, the least in its other columns. The window is over those rows alone."""
    again = if_small(saved(_keys(found.groupBy("_row").count().where("count > 1").select("_row")), "pipeline-again"))
    nth = F.row_number().over(Window.partitionBy(*_MARKS).orderBy("row"))
    one = docs.join(again, list(_MARKS), "left_semi").withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    return docs.join(again, list(_MARKS), "left_anti").unionByName(one)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go.

    Null and empty texts have statistics 0 and are judged by them, as all rows are, also repeated ones, each by itself; whole texts are read;
    rows without an id are judged, but none is learned from; an empty table gives an empty one; other columns stay as they are, also `score` and `predicted`.
    """
    model = learn_quality(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "text")
    return score_quality(rows, model).where("predicted = 1").select("row.*")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, and of equal rows one.

    Null counts as an empty text, and empty texts are equal; a null id is the smallest; of texts with the same id that differ in case alone, and of rows that differ
    in other columns alone, one stays, the same at each run; an empty table gives an empty one; other columns stay as they are.
    """
    marked = _marked(docs)
    found = settled(lambda: exact_dedup(marked, id_col="_row").select("_row", "kept"), "pipeline-exact")
    # Rows that are equal in id and text have the same marks: they go if none of them stays, else one of them stays.
    kept = found.where("kept").select("_row")
    gone = if_small(saved(_keys(found.where("not kept").select("_row").distinct().join(kept, "_row", "left_anti")), "pipeline-gone"))
    return _once(marked.drop("_row").join(gone, list(_MARKS), "left_anti"), found).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are linked by a similarity of 0.8 or more of their five-word shingles, the one with the smallest doc_id stays.

    Null, empty and blank texts are linked with nothing and stay; of texts with the same id the order of a hash decides; rows equal in id and text
    stay or go together; a null id is the smallest; an empty table gives an empty one; other columns stay as they are.
    """
    marked = _marked(docs)
    gone = if_small(settled(lambda: _keys(jaccard_components(marked, id_col="_row", n=5, percent=80).where(F.col("_row") != F.col("component_id")).select("_row").distinct()), "pipeline-near"))
    return marked.drop("_row").join(gone, list(_MARKS), "left_anti").select("row.*")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without a word are not taken.

    A null source is one more source, the last; null and empty texts have no word; rows that are equal in id and text are taken together, as copies of one of them;
    ties of the sampling keys go by id; an empty table gives an empty one; other columns stay as they are.
    """
    marked = _marked(docs)
    taken = settled(lambda: mix_sources(marked, id_col="_row").where("taken > 0").select("_row", F.expr("int(taken / size)").alias("_times")), "pipeline-mix")
    # Rows that are equal in id and text have the same marks: one of them stands for all that they take.
    times = if_small(saved(_keys(taken).groupBy(*_MARKS).agg(F.sum("_times").alias("_times")), "pipeline-taken"))
    rows = _once(marked.drop("_row"), taken).join(times, list(_MARKS))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit numbers) and the hash of the decoded bytes.

    A null or empty text has no token; texts of any length are encoded whole; each row by itself, also repeated rows and rows without an id;
    an empty table gives an empty one; other columns are ignored.
    """
    out = bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.expr("bigint(length(ids) / 4)").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("mixing sources to target weights", mix_stage),
    ("byte-level BPE", encode_stage),
]

#: Trained rules and the merges of BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(partial(stage, spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
