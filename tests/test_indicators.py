import random

import pytest

from quillon.operators import indicators, networks
from quillon.operators.components import connected_components

DOCS = [(1, 2000, "A", 10), (2, 2001, "A", 8), (3, 2001, "A", 5), (4, 2003, "A", 4), (5, 2003, "A", 3), (6, 2003, "B", None), (7, None, "B", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc long, year long, source string, cited long")


def brute_h(c):
    return max([h for h in range(len(c) + 1) if sum(x >= h for x in c) >= h])


def brute_g(c):
    c = sorted(c, reverse=True)
    return max([g for g in range(len(c) + 1) if sum(c[:g]) >= g * g])


def test_h_and_g_against_brute_force(spark):
    rng = random.Random(5)
    lists = {u: [rng.choice([0, 0, 1, 2, 3, 5, 8, 40, 400]) for _ in range(rng.randint(1, 30))] for u in range(150)}
    rows = spark.createDataFrame([(u, c) for u, cs in lists.items() for c in cs], "source long, cited long")
    assert {r[0]: r[1] for r in indicators.h_index(rows).collect()} == {u: brute_h(c) for u, c in lists.items()}
    assert {r[0]: r[1] for r in indicators.g_index(rows).collect()} == {u: brute_g(c) for u, c in lists.items()}


def test_sources_table_keeps_null_for_unreported(docs):
    rows = {r["source"]: r for r in indicators.sources_table(docs, 2004).collect()}
    assert (rows["A"]["h"], rows["A"]["g"], rows["A"]["rank"]) == (4, 5, 1)
    assert rows["A"]["m"] == pytest.approx(0.8)
    assert rows["B"]["h"] == 0 and rows["B"]["cited_docs"] == 1


def test_annual_fills_gaps(docs):
    rows = indicators.annual(docs, 2004).orderBy("year").collect()
    assert [(r["year"], r["n"], r["cumulative"]) for r in rows] == [(2000, 1, 1), (2001, 2, 3), (2002, 0, 3), (2003, 3, 6)]
    assert rows[2]["mean_cited"] is None


def test_empty_tables_do_not_fail(docs):
    none = docs.where("doc < 0")
    assert indicators.annual(none, 2004).count() == 0
    assert indicators.sources_table(none, 2004).count() == 0
    assert indicators.bradford_zones(none.groupBy("source").count().withColumnRenamed("count", "n")).count() == 0
    assert indicators.rpys(none.select("year")).count() == 0


def test_rpys_pads_the_ends(spark):
    years = spark.createDataFrame([(y,) for y, n in ((1990, 1), (1992, 9), (1993, 1)) for _ in range(n)], "year long")
    rows = {r["year"]: r for r in indicators.rpys(years).collect()}
    assert [r["n"] for _, r in sorted(rows.items())] == [1, 0, 9, 1]
    assert rows[1992]["peak"] and not rows[1993]["peak"]
    assert rows[1990]["median"] == 0


def test_lotka_constant_and_p_value():
    assert indicators.lotka_constant(2.0) == pytest.approx(0.6079, abs=1e-3)
    assert indicators.lotka_constant(1.0) is None
    assert indicators.ks_p_value(0.0, 100) == 1.0
    assert indicators.ks_p_value(0.136, 100) == pytest.approx(0.05, abs=0.012)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(500, 560)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_network_measures(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "c"), (3, "d"), (4, "a"), (4, "a"), (4, "")], "doc long, item string")
    inc, items = networks.incidence(rows)
    assert {r[0]: r[1] for r in items.collect()} == {"a": 3, "b": 2, "c": 2, "d": 1}
    edges = networks.network(networks.cooccurrence(inc), items, "association")
    assert {(r["src"], r["dst"]): round(r["weight"], 4) for r in edges.collect()} == {("a", "b"): 0.3333, ("a", "c"): 0.1667, ("b", "c"): 0.25, ("c", "d"): 0.5}
    t = networks.transitivity(edges).first()
    assert (t["triangles"], t["triples"]) == (1, 5)
    ranks = {r[0]: r[1] for r in networks.pagerank(edges).collect()}
    assert sum(ranks.values()) == pytest.approx(1)
