"""Duplicate records: link rules, groups, survivors.

items: rec, doi, title (normalised), year, surname, file. Rules
  1  equal DOI
  2  equal title of 10 characters or more and equal year, no DOI conflict, compatible surnames
  3  titles near each other in order (forwards or reversed, ``WINDOW`` apart at most) with
     similarity of the threshold or more, years that agree, the same numbers, no DOI conflict
All qualifying links count, whatever the order of visits; a group's similarity is the least of
its links, its reason the rule, or mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import numbers_of, surname_compatible, title_similarity
from quillon.operators.components import connected_components
from quillon.store import Stages

WINDOW = 4


def _conflict() -> Column:
    return (F.col("a.doi") != "") & (F.col("b.doi") != "") & (F.col("a.doi") != F.col("b.doi"))


def _chain(items: DataFrame, keys: list[str]) -> DataFrame:
    """Links of equal keys as a star on the smallest record, so that a large group makes as many rows as records."""
    first = items.groupBy(*keys).agg(F.min("rec").alias("src"))
    return items.join(first, keys).where("rec != src").select("src", F.col("rec").alias("dst"))


def doi_links(items: DataFrame) -> DataFrame:
    return _chain(items.where("doi != ''"), ["doi"]).withColumns({"reason": F.lit("doi"), "similarity": F.lit(1.0)})


def title_links(items: DataFrame) -> DataFrame:
    """Rule 2. Titles are compared by a 128-bit digest, and equal records (doi, surname) collapse first.

    Of a title and year only classes of different surname or DOI are paired; a class without both is compatible with
    every other and serves as the centre of a star. A class with a DOI meets those of the same DOI and those without one
    only, so that a title with many DOIs makes no pairs of them.
    """
    stages = Stages(items.sparkSession, "titles")
    some = items.where(F.length("title") >= 10).select(
        "rec", F.xxhash64("title").alias("t1"), F.xxhash64(F.lit(1), "title").alias("t2"), F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"), "doi", "surname"
    )
    some = stages.keep(some, "digests")
    key = ["t1", "t2", "year"]
    classes = stages.keep(some.groupBy(*key, "doi", "surname").agg(F.min("rec").alias("src"), F.count("*").alias("n")), "classes")
    same = some.join(classes.where("n > 1"), [*key, "doi", "surname"]).where("rec != src").select("src", F.col("rec").alias("dst"))
    free = classes.where("doi = '' and surname = ''").select(*key, F.col("src").alias("centre"))
    star = classes.join(free, key).where("src != centre").select(F.least("src", "centre").alias("src"), F.greatest("src", "centre").alias("dst"))
    rest = classes.join(free, key, "left_anti")
    many = rest.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").select(*key)
    rest = stages.keep(rest.drop("n").join(many, key), "rest")

    def paired(left: DataFrame, on: list[str], ok: Column) -> DataFrame:
        a, b = left.alias("a"), rest.alias("b")
        equal = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]
        found = a.join(b, equal).where(ok & surname_compatible(F.col("a.surname"), F.col("b.surname")))
        return found.select(F.least("a.src", "b.src").alias("src"), F.greatest("a.src", "b.src").alias("dst"))

    unnamed = paired(rest.where("doi = ''"), key, (F.col("b.doi") != "") | (F.col("a.src") < F.col("b.src")))
    pairs = unnamed.union(paired(rest.where("doi != ''"), [*key, "doi"], F.col("a.src") < F.col("b.src")))
    return same.union(star).union(pairs).withColumns({"reason": F.lit("title"), "similarity": F.lit(1.0)})


def _ranges(rows: DataFrame, key: Column, window: int, stages: Stages, name: str) -> DataFrame:
    """rows with part and own: ranges of the order by key and rec, each followed by the ``window`` rows after it (not own)."""
    order = [F.col("_key"), F.col("rec")]
    rows = rows.withColumn("_key", key).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    rows = stages.keep(rows, name)  # written once, so that a row keeps its part
    w = Window.partitionBy("part").orderBy(*order)
    head = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= window)
    counts = [(r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]
    carried = []
    for i, (part, _) in enumerate(counts):
        room, j = window, i - 1
        while room > 0 and j >= 0:
            carried.append((part, counts[j][0], room))
            room, j = room - counts[j][1], j - 1
    to = rows.sparkSession.createDataFrame(carried, "part int, to int, room int")  # ``window`` rows a part at most
    guests = head.join(F.broadcast(to), "part").where("_n <= room").drop("_n", "room", "part").withColumnRenamed("to", "part")
    return rows.withColumn("own", F.lit(True)).unionByName(guests.withColumn("own", F.lit(False)))


def neighbour_links(items: DataFrame, threshold: float = 0.95, window: int = WINDOW) -> DataFrame:
    """Rule 3. The sorted lists are cut into ranges, and the next rows are carried over each border: no link is lost."""
    some = items.where(F.length("title") >= 10)
    stages = Stages(items.sparkSession, "neighbours")
    out = None
    for name, key in (("forwards", F.col("title")), ("backwards", F.reverse("title"))):
        w = Window.partitionBy("part").orderBy("_key", "rec")
        rows = _ranges(some.select("rec", "doi", "title", "year", "surname", "file"), key, window, stages, name)
        rows = rows.select("*", *[F.lead(F.struct(*[F.col(c) for c in ("rec", "doi", "title", "year", "surname", "file")]), k).over(w).alias(f"n{k}") for k in range(1, window + 1)])
        rows = rows.where("own")
        pairs = rows.select(F.struct("rec", "doi", "title", "year", "surname", "file").alias("a"), F.explode(F.array(*[f"n{k}" for k in range(1, window + 1)])).alias("b")).where("b is not null")
        sim = title_similarity(F.col("a.title"), F.col("b.title"), threshold)
        years = (
            F.col("a.year").isNull() | F.col("b.year").isNull() | (F.col("a.year") == F.col("b.year"))
            | ((F.abs(F.col("a.year") - F.col("b.year")) == 1) & (F.col("a.file") != F.col("b.file")))
        )
        good = pairs.withColumn("similarity", sim).where(
            (F.col("similarity") >= threshold) & years & ~_conflict() & surname_compatible(F.col("a.surname"), F.col("b.surname"))
            & (numbers_of(F.col("a.title")) == numbers_of(F.col("b.title")))
        )
        good = good.select(F.least("a.rec", "b.rec").alias("src"), F.greatest("a.rec", "b.rec").alias("dst"), F.lit("title").alias("reason"), "similarity")
        out = good if out is None else out.union(good)
    return out.groupBy("src", "dst", "reason").agg(F.max("similarity").alias("similarity"))


def duplicate_groups(items: DataFrame, threshold: float = 0.95, kept_apart: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(group, rec) of groups with two records or more, and (group, n, reason, similarity, doi_conflict).

    ``kept_apart`` lists what the user has undone: records (rec), which then merge with nothing, whatever a later file
    adds, or groups (group) of this very table.
    """
    stages = Stages(items.sparkSession, "duplicates")
    if kept_apart is not None and "rec" in kept_apart.columns:
        items, kept_apart = items.join(kept_apart.select("rec").distinct(), "rec", "left_anti"), None
    items = stages.keep(items, "items")  # read by every rule
    links = stages.keep(doi_links(items).unionByName(title_links(items)).unionByName(neighbour_links(items, threshold)), "links")
    members = connected_components(links).select(F.col("component").alias("group"), F.col("node").alias("rec"))
    if kept_apart is not None:
        members = members.join(kept_apart, "group", "left_anti")
    n = members.groupBy("group").agg(F.count("*").alias("n"))
    why = links.join(members, links["src"] == members["rec"]).groupBy("group").agg(
        F.when(F.countDistinct("reason") > 1, "mixed").otherwise(F.min("reason")).alias("reason"), F.min("similarity").alias("similarity")
    )
    conflict = items.join(members, "rec").groupBy("group").agg((F.countDistinct(F.nullif(F.col("doi"), F.lit(""))) > 1).alias("doi_conflict"))
    return members, n.join(why, "group").join(conflict, "group")


def survivors(records: DataFrame, members: DataFrame, score: Column, longest: list[str], first: list[str], lists: list[str], sums: list[str]) -> DataFrame:
    """One merged row per group: base = highest score (then smallest rec).

    ``longest`` texts and ``lists`` take the longest value, ``first`` the first filled one in order of score,
    ``sums`` (citations) the largest. A group is aggregated with map-side combine, never gathered.
    """
    rows = members.join(records, "rec").withColumn("_s", score)
    order = lambda filled: F.struct(filled, F.col("_s"), (-F.col("rec")).alias("r"))
    kinds = dict(records.dtypes)
    filled = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "" if kinds[c] == "string" else F.lit(True))
    take = [F.max_by("rec", order(F.lit(1))).alias("base"), F.count("*").alias("merged")]
    take += [F.max_by(c, F.struct(F.coalesce(F.length(c), F.lit(-1)), F.col("_s"), -F.col("rec"))).alias(c) for c in longest]
    take += [F.max_by(c, order(filled(c).cast("int"))).alias(c) for c in first]
    take += [F.max_by(c, F.struct(F.coalesce(F.size(c), F.lit(-1)), F.col("_s"), -F.col("rec"))).alias(c) for c in lists]
    take += [F.max(c).alias(c) for c in sums]
    return rows.groupBy("group").agg(*take)


def record_score(texts: list[str], lists: list[str]) -> Column:
    """How many fields are filled."""
    out = F.lit(0)
    for c in texts:
        out = out + (F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int")
    for c in lists:
        out = out + (F.coalesce(F.size(c), F.lit(0)) > 0).cast("int")
    return out
