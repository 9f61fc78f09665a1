"""A training-data pipeline: each stage reads what the one before it kept.

toxicity            rows that score 0.5 or more go
near_duplicates     one document of each group of linked documents stays, the smallest id; two link if their
                    five-word shingles have a Jaccard similarity of 0.8 or more
decontamination     documents that hold a benchmark item go
pii                 entities get surrogates, n_chars is counted anew
mixing              every document gets its domain, rate and copies; rows with no copy go

The fourth stage and those before it return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import decontam, mixing, ngram_join, pii, toxicity
from quillon.llm.exprs import fresh
from quillon.store import Stages

#: Models of this pipeline are not expressible in SQL; stages are tested one by one.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5, with all their columns.

    A null or empty text has the score of the bias alone. Repeated rows and null ids are judged row by row, very long
    texts whole. Without labels of both kinds the base rate decides; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the smallest id of each component; of repeated rows of an id, the one with the smallest hash of all columns stays.

    Rows without an id stay, and so do null and empty texts, which are linked with nothing. Columns may have any name
    and any type.
    """
    found = ngram_join.ngram_jaccard_components(docs, threshold=80, shingle=5)
    key, n = fresh(docs.columns, "_id", "_n")
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    named = docs.where("doc_id is not null").join(keep, F.col("doc_id") == F.col(key)).drop(key)
    plain = [F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in docs.dtypes]
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*plain))
    one = named.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).drop(n)
    return one.unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, with all their columns; null and empty texts stay, repeated rows go together."""
    return decontam.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns, with surrogates in the text and n_chars counted anew; a null text stays null."""
    return pii.replace_in(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of one copy or more, with n_tokens, domain, rate and copies, which replace columns so called.

    A null or empty text has no tokens and the rate of the prior; repeated rows keep their rows and equal rates.
    """
    out = mixing.mix_to_targets(docs, mixing.domains_from(docs, _table(spark, sf_dir, "labels")), mixing.target_weight)
    names = {"_tokens": "n_tokens", "_domain": "domain", "_rate": "rate", "_copies": "copies"}
    return out.where("_copies > 0").drop(*[c for c in out.columns if c.lower() in names.values()]).withColumnsRenamed(names)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    stages = Stages(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stages.keep(stage(spark, docs, sf_dir), name)
    return docs
