from pyspark.sql import functions as F

from quillon.operators import analysis, networks
from quillon.plans.views import REFERENCE_YEAR, Collection
from quillon.streaming.ingest import append_and_refresh, windowed_counts

SMALL = "/root/testdata/sf0.001"


def test_periods():
    assert analysis.periods(2000, 2010, [2004, 1999, 2010, 2007]) == [(2000, 2004), (2005, 2007), (2008, 2010)]
    assert analysis.periods(2000, 2000, [2000]) == [(2000, 2000)]


def test_evolution_and_measures(spark):
    rows = [(d, w, 2000 + (d > 10)) for d in range(20) for w in (("a", "b", "c") if d % 2 else ("x", "y", "z"))]
    df = spark.createDataFrame(rows, "doc long, item string, year int")
    themes, links = analysis.thematic_evolution(df, [(2000, 2000), (2001, 2001)])
    assert themes.groupBy("period", "community").count().where("count = 3").count() == 4
    assert {(r["a"] == r["b"], r["shared"], r["inclusion"]) for r in links.collect()} <= {(True, 3, 1.0), (False, 3, 1.0)}
    inc, items = networks.incidence(df)
    nodes, whole = analysis.network_analysis(networks.network(networks.cooccurrence(inc), items))
    assert nodes.count() == 6 and whole.first()["transitivity"] == 1.0


def test_coupling_and_terms(spark):
    docs = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "doc long, cited long")
    cited = spark.createDataFrame([(1, "r1"), (1, "r2"), (2, "r1"), (2, "r2"), (3, "r2")], "doc long, item string")
    inc, units = analysis.coupling_units(docs, cited)
    chosen = analysis.select_units(units, 3)
    assert [r["unit"] for r in chosen.collect()] == [3, 1, 2]
    edges = {(r["src"], r["dst"]): round(r["weight"], 4) for r in analysis.coupling_network(inc, chosen).collect()}
    assert edges == {(1, 2): 1.0, (1, 3): 0.7071, (2, 3): 0.7071}
    terms = spark.createDataFrame([(1, "t"), (2, "t"), (3, "u")], "doc long, term string")
    found = analysis.cluster_terms(terms, spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "node long, community long"))
    assert {(r["community"], r["term"]) for r in found.collect()} == {(0, "t"), (1, "u")}


def test_run_all_is_complete(spark):
    tables = analysis.run_all(Collection(spark, SMALL), REFERENCE_YEAR)
    assert len(tables) == 14 and tables["sources"].count() > 0


def test_stream_appends_and_refreshes(spark, tmp_path):
    seen = []
    spark.createDataFrame([(1, "a"), (2, "b")], "doc long, source string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc long, source string").parquet(str(tmp_path / "in"))
    query = append_and_refresh(stream, str(tmp_path / "all"), lambda df: seen.append(df.count()), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert seen == [2]


def test_windowed_counts_in_batch_form(spark):
    df = spark.createDataFrame([("2020-01-01 00:10:00", "a"), ("2020-01-01 00:20:00", "a"), ("2020-01-01 01:20:00", "a")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in windowed_counts(df, "t", "k").collect()) == [1, 2]


def test_cited_sources_are_grouped_by_abbreviation(spark):
    from quillon.operators.citations import cited_source_groups

    names = [("J Ecol", 3), ("Journal of Ecology", 2), ("J. Ecol.", 1), ("J ECON", 1), ("PhytoKeys", 1), ("Phyto Keys", 1), ("Phys Rev", 1), ("Physical Review", 1), ("Physics Reviews", 1), ("", 1), ("...", 1), (None, 4)]
    got = {r["source"]: (r["grp"], r["label"]) for r in cited_source_groups(spark.createDataFrame(names, "source string, n long")).collect()}
    assert got["J Ecol"] == got["Journal of Ecology"] == got["J. Ecol."] and got["J Ecol"][1] == "Journal of Ecology"
    assert got["J ECON"] != got["J Ecol"] and got["PhytoKeys"] == got["Phyto Keys"]
    assert len({got[x][0] for x in ("Phys Rev", "Physical Review", "Physics Reviews")}) == 3  # an abbreviation of two titles stays apart
    assert set(got) == {n for n, _ in names if n and n != "..."}
    assert cited_source_groups(spark.createDataFrame([], "source string, n long")).count() == 0
