"""Factorial analysis of words: the cross table by joins, eigenvectors and clusters in a kernel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import kernels, networks


def _cross(inc: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """Co-occurrence counts, item counts on the diagonal, and the number of documents, in one frame of pairs."""
    pairs = networks.cooccurrence(inc).select("src", "dst", "count")
    own = items.select(F.col("item").alias("src"), F.col("item").alias("dst"), F.col("freq").alias("count"))
    return pairs.unionByName(own).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))


def _matrix(pdf: pd.DataFrame) -> tuple[list, np.ndarray, int]:
    names = sorted(set(pdf["src"]))
    names = sorted(set(names) | set(pdf["dst"]))
    at = {x: i for i, x in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b, k in pdf[["src", "dst", "count"]].itertuples(index=False):
        m[at[a], at[b]] = m[at[b], at[a]] = k
    return names, m, int(pdf["n"].iloc[0])


def factorial_words(inc: DataFrame, items: DataFrame, docs: DataFrame, clusters: int | None = None) -> DataFrame:
    """(item, x, y, cluster) by multiple correspondence analysis and k-means on two dimensions."""
    kind = dict(items.dtypes)["item"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m, n = _matrix(pdf)
        x = kernels.multiple_correspondence(m, n, 2)["columns"][:, :2]
        x = np.pad(x, ((0, 0), (0, 2 - x.shape[1])))
        k = clusters or kernels.suggest_k(x)
        return pd.DataFrame({"item": names[: len(x)], "x": x[:, 0], "y": x[:, 1], "cluster": kernels.kmeans(x, k)[0].astype(np.int64)})

    return _cross(inc, items, docs).withColumn("map", F.lit(0)).groupBy("map").applyInPandas(run, f"item {kind}, x double, y double, cluster long")


def word_clusters(inc: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """(step, a, b, height, size) of Ward's tree over the same map."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, m, n = _matrix(pdf)
        rows = kernels.ward(kernels.multiple_correspondence(m, n, 2)["columns"][:, :2])
        return pd.DataFrame([(i, a, b, round(h, 6), s) for i, (a, b, h, s) in enumerate(rows)], columns=["step", "a", "b", "height", "size"])

    return _cross(inc, items, docs).withColumn("map", F.lit(0)).groupBy("map").applyInPandas(run, "step long, a long, b long, height double, size long")


#: Items of a correspondence analysis at most; their cross table is decomposed on the driver.
MAX_ITEMS = 1000


def cross_table(inc: DataFrame) -> DataFrame:
    """(src, dst, weight), src <= dst: over the documents with both items the sum of one over the document's items.

    ``inc`` has each (doc, item) once. It is the table of items by items that a correspondence analysis of documents by
    items decomposes; the table of documents is never made dense.
    """
    k = inc.groupBy("doc").agg((1.0 / F.count("*")).alias("w"))
    weighted = inc.join(k, "doc")
    a, b = weighted.select("doc", F.col("item").alias("src"), "w"), inc.select("doc", F.col("item").alias("dst"))
    return a.join(b, "doc").where("src <= dst").groupBy("src", "dst").agg(F.sum("w").alias("weight"))


def correspondence_binary(inc: DataFrame, dims: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Correspondence analysis of documents by items without a dense table of documents.

    Gives (dim, inertia, percent), items (item, dim, coordinate, contribution, cos2) and documents (doc, dim, coordinate,
    contribution). A document's coordinate is the mean of its items', divided by the root of the inertia, by a join.
    Items are bounded by ``MAX_ITEMS``; documents are not. An empty table gives empty results.
    """
    spark = inc.sparkSession
    counts = inc.groupBy("item").agg(F.count("*").alias("f")).limit(MAX_ITEMS + 1).toPandas()  # bounded
    if len(counts) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items: keep the most frequent ones first (networks.incidence)")
    names = sorted(counts["item"])
    at = {x: i for i, x in enumerate(names)}
    total = float(counts["f"].sum())
    mass = np.zeros(len(names))
    for x, f in counts.itertuples(index=False):
        mass[at[x]] = f / (total or 1.0)
    s = np.zeros((len(names), len(names)))
    for a, b, w in cross_table(inc).toPandas().itertuples(index=False):  # MAX_ITEMS squared rows at most
        s[at[a], at[b]] = s[at[b], at[a]] = w / total
    root = np.sqrt(mass)
    lam, v = kernels.eigen(s / np.outer(root, root) - np.outer(root, root)) if names else (np.zeros(0), np.zeros((0, 0)))
    good = lam > 1e-11
    every, lam, v = float(lam[good].sum()), lam[good][:dims], v[:, good][:, :dims]
    coordinates = v * np.sqrt(lam) / root[:, None] if names else v
    distance = (np.diag(s) / np.where(mass > 0, mass, 1) ** 2 - 1) if names else np.zeros(0)  # squared distance of an item to the centre
    kind = dict(inc.dtypes)["item"]
    inertia = spark.createDataFrame([(k + 1, float(x), 100 * float(x) / every) for k, x in enumerate(lam)], "dim int, inertia double, percent double")
    rows = [(x, k + 1, float(coordinates[i, k]), float(v[i, k] ** 2), float(coordinates[i, k] ** 2 / distance[i]) if distance[i] > 1e-12 else 0.0) for i, x in enumerate(names) for k in range(len(lam))]
    items = spark.createDataFrame(rows, f"item {kind}, dim int, coordinate double, contribution double, cos2 double")
    size = inc.groupBy("doc").agg(F.count("*").alias("k"))
    documents = inc.join(items.select("item", "dim", "coordinate"), "item").groupBy("doc", "dim").agg(F.sum("coordinate").alias("s")).join(size, "doc").join(inertia.select("dim", "inertia"), "dim")
    place = F.col("s") / F.col("k") / F.sqrt("inertia")
    return inertia, items, documents.select("doc", "dim", place.alias("coordinate"), (F.col("k") / F.lit(total or 1.0) * place * place / F.col("inertia")).alias("contribution"))
