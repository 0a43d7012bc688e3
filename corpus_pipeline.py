"""The corpus pipeline: quality filter, line dedup, SimHash near-dedup, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import line_dedup, packing, quality, simhash
from fluvia.session import materialize, ship


ROW = "__row"


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one struct, so that no name of theirs meets an operator's own columns."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias(ROW))


def restored(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, with the text of ``kept``."""
    return kept.select(*(F.col("text") if c == "text" else F.col(ROW)[c].alias(c) for c in docs.columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with all their columns, clashing names or not.

    It learns from the labels of this input's documents alone. Null or empty text is scored as an empty text; equal texts
    are all kept or all dropped, a null id like any other; an empty table gives an empty one.
    """
    ship(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return restored(quality.score(carried(docs), model, keep=[ROW, "text"]).where("predicted = 1"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that one of smaller id has; n_chars follows the text.

    All rows and columns stay. Null text becomes empty; rows of equal id are one document; a row of null id loses no line
    and takes none from others; an empty table gives an empty one.
    """
    ship(spark)
    kept = restored(line_dedup.line_dedup(carried(docs)), docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group whose five-word shingles are similar by 0.8 or more.

    Null and blank texts are copies of each other; rows of equal id are one document; rows of null id all stay; all
    columns stay; an empty table gives an empty one.
    """
    ship(spark)
    return simhash.drop_near_duplicates(docs, width=5, similarity=0.8).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens.

    Null text is an empty document, one end token; repeated rows and null ids are packed each; other columns are left
    out; an empty table gives an empty result.
    """
    ship(spark)
    return packing.pack(docs, keep=["doc_id"])


STAGES = [("quality", keep_good), ("line_dedup", drop_repeated_lines), ("simhash", drop_near_copies), ("packing", pack_sequences)]

#: Tokens, fingerprints and a fitted model are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
