"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage keeps as Parquet and
gives it to the next. All stages but the last return the columns of documents. Null texts and ids, empty tables and repeated
rows are treated as the operators' own docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import common, jaccard_join, mixing, packing, quality, suffix_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go. The verdict is each row's own, also where ids repeat or are null."""
    labels = common.read(spark, sf_dir, "labels")
    _, own = common.numbered(docs, "doc_id", "text")
    rows, row = (docs, "doc_id") if own is None else (own, "__doc")
    verdicts = quality.judge_quality(rows, labels, keep=() if own is None else (row,)).filter("kept").select(F.col(row).alias("__id"))
    kept = rows.join(verdicts, rows[row] == F.col("__id"), "left_semi")
    return kept if own is None else kept.drop(row)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles, directly or through others, that with the smallest id stays; one of rows that share it."""
    return jaccard_join.first_of_components(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every passage of 100 bytes or more stays at its first place only; documents of which nothing is left go."""
    cut = suffix_dedup.remove_repeats(docs).filter((F.col("n_removed") == 0) | (F.length("kept_text") > 0))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.select(*[text.alias(c) if c == "text" else F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col(c)).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get their shares of words: a row for each epoch of a document, the last of a source cut at its budget."""
    return mixing.mix_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as pieces of token sequences."""
    return packing.pack_documents(docs, packing.vocabulary())


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("mixed sources", mixed_sources), ("packed sequences", packed_sequences)]

#: Stages learn, compare sets and tokenise, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialise(docs, f"stage-{k}")
    return docs
