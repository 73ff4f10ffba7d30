"""The corpus pipeline: STAGES are applied in turn, each over all that its predecessor kept.

Every stage is written to the shared folder and read again. All but the last return the columns
of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import mixing, ngram_join, packing, suffix_dedup, toxicity
from proofloom.llm.common import discard, free_name, ship, written
from proofloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5, with all their columns; where most labels are toxic, also those whose own n-grams don't raise their score.

    So null and empty texts stay, and labels that tell no n-gram apart reject nothing. Nothing in, nothing out.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model, name = toxicity.fit(docs, labels), free_name(docs.columns, "score")
    blank = float(model.scores([None])[0])
    return toxicity.score(docs, model, name=name).where((F.col(name) < 0.5) | (F.col(name) <= blank)).drop(name)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by five-word shingles at a similarity of 0.8 or more.

    Rows equal in doc_id and text are one row; texts without words all stay.
    """
    ship(spark)
    return ngram_join.one_of_each(docs, ngram_join.Terms(5, 80, 100))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they occur first; a text that is all repeats goes. Null, empty and shorter texts pass."""
    ship(spark)
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in turn weigh 3, 1, 2; a document that the mix repeats has a row per epoch. Texts without words are in no mix; null is a source."""
    ship(spark)
    return mixing.mixed_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; a longer document is cut into pieces, a null or empty text is its end id alone."""
    ship(spark)
    cut = packing.pieces(docs.select("doc_id", "text"), "doc_id", "text", tokenizer_path(), 1, 4096)
    return packing.pack_pieces(cut, 4096).withColumnRenamed("key", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can express neither a fitted classifier nor a tokenizer; each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
            discard(before)  # nothing reads it any more; the input is not a table of ours
    return docs
