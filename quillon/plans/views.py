"""Adapter: the driver's tables seen as a bibliographic collection.

document = order, source = customer, signature = supplier of a line, keyword and cited work =
part of a line, country = supplier's nation (corresponding: customer's), citations from the price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE_YEAR = 2002
TOP_PARTS = 400


class Collection:
    """Lazy views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def docs(self) -> DataFrame:
        """doc, year, source, doc_type, language, cited."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("doc"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_custkey").alias("source"), F.col("o_orderstatus").alias("doc_type"),
            F.col("o_orderpriority").alias("language"), F.floor(F.col("o_totalprice").cast("double") / 50000).cast("long").alias("cited"),
        )

    @property
    def authors(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("author"))

    @property
    def keywords(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("term"))

    @property
    def references(self) -> DataFrame:
        """(doc, ref, year): cited works, with the ship year for the reference year."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("ref"), F.year("l_shipdate").cast("long").alias("year"))

    @property
    def countries(self) -> DataFrame:
        """(doc, country) of the suppliers."""
        s = self.table("supplier").select(F.col("s_suppkey").alias("author"), F.col("s_nationkey").alias("country"))
        return self.authors.join(s, "author").select("doc", "country")

    @property
    def docs_with_countries(self) -> DataFrame:
        """docs with countries (a list) and country, the corresponding one."""
        lists = self.countries.groupBy("doc").agg(F.collect_set("country").alias("countries"))  # up to one per line of an order
        home = self.table("customer").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").alias("country"))
        return self.docs.join(lists, "doc", "left").join(home, "source", "left").withColumn("countries", F.coalesce("countries", F.array().cast("array<bigint>")))

    @property
    def texts(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("doc"), "text", "lang", "source")
