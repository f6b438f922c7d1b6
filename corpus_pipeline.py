"""From raw documents to packed sequences: language ID, line dedup, near-duplicate groups, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latticework.llm import decontaminate, lang_id, line_dedup, ngram_join, packing
from latticework.llm.common import fold, table
from latticework.storage import Scratch

#: Below this the two steps of the language decision together are no better than a guess among four.
LEAST_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter, or no clear decision. Without labels letters decide."""
    model = lang_id.fit(docs, F.coalesce(fold(F.col("doc_id"), 4) != 2, F.lit(True)))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = lang_id.predict(docs, model)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines, and documents of which nothing is left; ``n_chars`` follows the text."""
    cleaned = line_dedup.drop_lines(docs)
    left = cleaned.where((F.col("n_dropped") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group (five-word shingles, similarity 0.8)."""
    groups = ngram_join.near_duplicates(docs, words=5, percent=80)
    firsts = groups.where("doc_id = component_id").select("doc_id").distinct()
    same = Window.partitionBy("doc_id", "_text").orderBy("doc_id")
    kept = docs.join(firsts, "doc_id", "left_semi").withColumn("_text", F.xxhash64("text")).withColumn("_row", F.row_number().over(same))
    return kept.where("_row = 1").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, as it is or with other numbers and names."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence of 2048 tokens and place there."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", benchmark),
    ("packing", sequences),
]

#: Tokenisation and the language model are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = scratch.put(out)
            scratch.drop(docs)
        docs = out
    return docs
