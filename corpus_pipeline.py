"""A training corpus in five stages: toxicity, near duplicates, benchmark contamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``docs``;
the last returns one row for each packed piece. ``run`` applies them to the documents of a folder. Stages whose last step
is Python write their table, so that their Arrow batches stay small whatever the session says.

Defined cases: a null text counts as empty and stays null; rows of one doc_id, or of none, are documents of their own
where their texts differ, and one document where they agree; extra columns, whatever their names, pass through as they
are; an empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.llm import decontaminate, near_dup, packing, pii, toxicity
from ranklake.llm.exchange import dropped, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; the model trains on the labelled ones among them."""
    model = toxicity.train(toxicity.training_rows(docs, _table(spark, sf_dir, "labels")))
    return written(toxicity.keep_clean(docs, model), "clean")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest (doc_id, text digest) of each near-duplicate class."""
    return near_dup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves alone."""
    return decontaminate.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a type in brackets for each span of personal data, and their new lengths."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))
    return written(out, "redacted")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("packing", pack),
]

#: Model decisions and hashed candidates have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name in ("near_duplicates", "decontamination"):  # the others return tables
            docs = written(docs, name)
        if name != "toxicity":
            dropped(spark, [before])
    return STAGES[-1][1](spark, docs, sf_dir)
