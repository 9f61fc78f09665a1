"""A collection that grows by batches, kept up to date without being read anew.

``DuplicateIndex`` keeps what the rules of equal DOI and equal title need of each record, and the groups found so far. A
batch meets only records that share a DOI or a title and year with it: those carry all links that it can make, so that
batches one by one give the groups of all at once. ``fold_batches`` keeps sums by key. Each batch writes a part of its own
number in every table, so that one that is repeated after a failure replaces itself and reads only earlier ones.

The rule of near titles looks at neighbours in the order of all titles, which later records change; ``duplicate_groups``
applies it to a whole collection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators import dedup
from quillon.operators.components import connected_components
from quillon.store import Stages

ITEM = "rec long, doi string, title string, year int, surname string, t1 long, t2 long, id string, batch int"
MEMBER = "rec long, grp string, batch int"


class DuplicateIndex:
    """Groups of duplicate records (rec, doi, title normalised, year, surname) under ``folder``, which all machines share.

    A group is called by its oldest record (batch, then rec), so that no later batch renames it; if a batch joins two
    groups, the older name stays. ``rec`` is unique in the collection; null DOIs, titles and surnames count as empty.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str, before: int) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)
        return rows.where(F.col("batch") < before)

    def groups(self, before: int = 2**31 - 1) -> DataFrame:
        """(rec, grp) of the records in a group of two or more."""
        rows = self._read("groups", MEMBER, before)
        return rows.groupBy("rec").agg(F.max_by("grp", "batch").alias("grp"))

    def add(self, items: DataFrame, number: int) -> None:
        """Takes in batch ``number``; numbers ascend."""
        stages = Stages(self.spark, "refresh")
        text = lambda c: F.coalesce(F.col(c), F.lit(""))
        own = items.select("rec", text("doi").alias("doi"), text("title").alias("title"), F.col("year").cast("int").alias("year"), text("surname").alias("surname"))
        own = own.select("*", F.xxhash64("title").alias("t1"), F.xxhash64(F.lit(1), "title").alias("t2"), F.concat(F.lpad(F.lit(str(number)), 10, "0"), F.lit("-"), F.lpad(F.hex("rec"), 16, "0")).alias("id"))
        own.write.mode("overwrite").parquet(f"{self.folder}/items/batch={number}")
        own = self.spark.read.schema(ITEM.removesuffix(", batch int")).parquet(f"{self.folder}/items/batch={number}")
        known = self._read("items", ITEM, number).drop("batch")
        by_doi = known.where("doi != ''").join(own.where("doi != ''").select("doi").distinct(), "doi", "left_semi")
        titles = own.where(F.length("title") >= 10).select("t1", "t2", F.col("year").alias("y")).distinct()
        near = known.join(titles, (known["t1"] == titles["t1"]) & (known["t2"] == titles["t2"]) & known["year"].eqNullSafe(titles["y"]), "left_semi")
        local = own.unionByName(by_doi).unionByName(near).dropDuplicates(["rec"])
        before = self.groups(number)
        local = stages.keep(local.join(before, "rec", "left").withColumn("node", F.coalesce("grp", "id")), "local")
        links = dedup.doi_links(local).unionByName(dedup.title_links(local)).select("src", "dst")
        node = local.select("rec", "node")
        edges = links.join(node.withColumnsRenamed({"rec": "src", "node": "a"}), "src").join(node.withColumnsRenamed({"rec": "dst", "node": "b"}), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        found = stages.keep(connected_components(stages.keep(edges.where("src != dst").distinct(), "edges")), "components")
        joined = local.join(found, "node").where("grp is null or grp != component").select("rec", F.col("component").alias("grp"))
        moved = before.join(found.withColumnRenamed("node", "grp"), "grp").where("grp != component").select("rec", F.col("component").alias("grp"))
        joined.unionByName(moved).distinct().write.mode("overwrite").parquet(f"{self.folder}/groups/batch={number}")


def follow(stream: DataFrame, index: DuplicateIndex, checkpoint: str) -> StreamingQuery:
    """Takes in a stream of items, a micro-batch at a time."""
    return stream.writeStream.foreachBatch(index.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_batches(stream: DataFrame, folder: str, keys: Sequence[str], sums: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Keeps (keys, n, sums) of all rows so far: a batch is summed and added to the table of the batch before (``folded``)."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        part = batch.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
        if number:
            part = spark.read.schema(part.schema).parquet(f"{folder}/v{number - 1}").unionByName(part)
        part.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", *sums)]).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, folder: str) -> DataFrame:
    """The newest table of ``fold_batches``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return spark.read.parquet(f"{folder}/v{max(int(s.getPath().getName()[1:]) for s in listed)}")
