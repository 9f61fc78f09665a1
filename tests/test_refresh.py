import random

from pyspark.sql import functions as F

from quillon.operators import dedup
from quillon.operators.components import connected_components
from quillon.streaming import refresh

ITEM = "rec long, doi string, title string, year int, surname string"


def rows_of(n):
    rng = random.Random(n)
    titles = [f"a study of the plants number {k}" for k in range(12)]
    return [(k * 7 - 50, rng.choice(["", "", f"10.1/{rng.randrange(15)}"]), rng.choice(titles), rng.choice([2001, 2002, None]), rng.choice(["", "doe", "roe"])) for k in range(n)]


def test_batch_by_batch_equals_all_at_once(spark, tmp_path):
    rows = rows_of(90)
    index = refresh.DuplicateIndex(spark, f"file://{tmp_path}/index")
    names = {}
    for number, part in enumerate((rows[:30], rows[30:31], rows[31:70], [], rows[70:])):
        index.add(spark.createDataFrame(part, ITEM), number)
        if number == 2:
            index.add(spark.createDataFrame(part, ITEM), number)  # a repeated batch replaces itself
        now = {r["rec"]: r["grp"] for r in index.groups().collect()}
        for rec, grp in names.items():
            assert now[rec] <= grp  # a name stays, or is that of an older group
        names = now
    items = spark.createDataFrame(rows, ITEM).fillna({"doi": ""})
    links = dedup.doi_links(items).unionByName(dedup.title_links(items))
    whole = {}
    for r in connected_components(links).collect():
        whole.setdefault(r["component"], set()).add(r["node"])
    mine = {}
    for rec, grp in names.items():
        mine.setdefault(grp, set()).add(rec)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, whole.values()))
    batch_of = {r[0]: k for k, part in enumerate((rows[:30], rows[30:31], rows[31:70], [], rows[70:])) for r in part}
    assert all(int(grp[:10]) == min(batch_of[x] for x in recs) for grp, recs in mine.items())


def test_sums_of_batches(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(2000 + i % 4, i) for i in range(k * 10, k * 10 + 10)], "year long, cited long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("year long, cited long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    refresh.fold_batches(stream, f"file://{tmp_path}/sums", ["year"], ["cited"], f"{tmp_path}/at").awaitTermination(120)
    got = {r["year"]: (r["n"], r["cited"]) for r in refresh.folded(spark, f"file://{tmp_path}/sums").collect()}
    want = spark.read.parquet(f"{tmp_path}/in").groupBy("year").agg(F.count("*").alias("n"), F.sum("cited").alias("c")).collect()
    assert got == {r["year"]: (r["n"], r["c"]) for r in want} and sum(n for n, _ in got.values()) == 30
