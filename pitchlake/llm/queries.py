"""Registered queries of the operators, and the SQL that DuckDB runs beside them where SQL can say the same.

Each query applies its operator with production parameters to its whole table and derives the digest columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audit, credentials, decontam, jaccard, licences, mixing, neighbours, personal, quality, ranking, repeats, sketches, toxicity
from .sql import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_personal_data")
def _(spark, sf_dir):
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    base = [k for k in personal.KINDS if k != "iban"]
    return found.select("doc_id", *[F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in base],
                        F.sha2(personal.joined("s.kind != 'iban'"), 256).alias("base_sha256"), personal.joined().alias("spans"))


@query("op4_decontaminate")
def _(spark, sf_dir):
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op5_secret_scan")
def _(spark, sf_dir):
    found = credentials.find_credentials(table(spark, sf_dir, "documents"))
    place = {k: i for i, k in enumerate(credentials.KINDS)}
    order = "CASE s.kind " + " ".join(f"WHEN '{k}' THEN {i}" for k, i in place.items()) + " END"
    spot = f"named_struct('start', s.start, 'at', {order}, 'name', concat(s.kind, ':', s.start, ':', s.stop))"
    both = f"array_join(transform(array_sort(concat(transform(base, s -> {spot}), transform(added, s -> {spot}))), s -> s.name), ',')"
    base = f"array_join(transform(array_sort(transform(base, s -> {spot})), s -> s.name), ',')"
    return found.select("doc_id", *[F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in credentials.KINDS[:3]],
                        F.sha2(F.expr(base), 256).alias("base_sha256"), F.expr(both).alias("spans"))


@query("op6_mix_sources")
def _(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op8_quality")
def _(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


@query("op9_license_scan")
def _(spark, sf_dir):
    return licences.scan_licenses(table(spark, sf_dir, "documents")).drop("text_key", "spans")


@query("op10_toxicity")
def _(spark, sf_dir):
    return toxicity.tag_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


@query("op7_jaccard_join")
def _(spark, sf_dir):
    return jaccard.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op2_repeats")
def _(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_nearest")
def _(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query("op13_filter_audit")
def _(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_ranked_search")
def _(spark, sf_dir):
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_near_duplicates")
def _(spark, sf_dir):
    found = sketches.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
