"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, source mixing.

Every stage takes (spark, docs, sf_dir) and gets what its predecessor kept; all but the last return the columns of
documents. `run` writes each stage's result as Parquet in the shared folder and rereads it as the next one's docs.

End to end: documents with a null or empty text pass the filters but never come out, as the mix takes no words of them.
Rows equal in doc_id and text are judged alike and count as one copy, of which any one row stays; of different texts that
are near copies the least doc_id stays. A null source is a source of its own, null doc_ids are kept like others. Columns
of documents go through under their names, but for size, source_size, target and taken, which the mix replaces. Without
documents the result is empty, without labels or benchmark items the stage that reads them drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchlake.llm import decontam, jaccard, mixing, personal, toxicity
from pitchlake.llm.tables import stored, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field rejects go; it learns from `labels` of the documents at hand."""
    tagged = toxicity.tag_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), spans=False)
    return without(docs, tagged.filter("predicted = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar 5-word shingles (0.8 or more) the one with the least doc_id stays."""
    return jaccard.one_of_each(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.filter("contaminated"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in brackets; n_chars follows the text."""
    return personal.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken (words, repeats counted), which replace columns of that name."""
    own = {"size", "source_size", "target", "taken"}
    return mixing.mix_sources(docs, carry=tuple(c for c in docs.columns if c not in own)).filter("taken > 0")


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("decontamination", drop_contaminated), ("personal data", redact_personal), ("mixing", mix)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage{number}")
    return docs
