"""Queries over whole tables, against brute force."""

import random
from collections import defaultdict
from itertools import combinations

import pytest

from quillon.plans import queries as core

CHAIN = 200


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    rng = random.Random(5)
    orders = [(o, 100 + o % 90) for o in range(1, 6001, 40)]
    lines = [(o, n, rng.randint(1, 60), rng.randint(1, 80) if n else 7) for o, _ in orders for n in range(3)]
    lines += [(5000, 9, 1000 + k // 2, 5000 + (k + 1) // 2) for k in range(CHAIN)]  # one deep component
    folder = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_suppkey long, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(*o, "O", "1-URGENT", 1.0, "1995-01-01") for o in [*orders, (5000, 170)]], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double, o_orderdate string").selectExpr(
        "* except (o_orderdate)", "date(o_orderdate) as o_orderdate"
    ).write.parquet(f"{folder}/orders.parquet")
    return folder, lines, dict([*orders, (5000, 170)])


def test_coupling_of_all_sources(spark, lines):
    folder, rows, source = lines
    items = defaultdict(set)
    for o, _, _, part in rows:
        items[source[o]].add(part)
    want = {(a, b): (n, round(n / (len(items[a]) * len(items[b])) ** 0.5, 6)) for a, b in combinations(sorted(items), 2) if (n := len(items[a] & items[b]))}
    got = {(r["src"], r["dst"]): (r["count"], r["weight"]) for r in core.QUERIES["coupling_pairs_salton"](spark, folder).collect()}
    assert max(b for _, b in got) > 150 and got == want


def test_components_of_all_lines(spark, lines):
    folder, rows, _ = lines
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for _, _, supplier, part in rows:
        a, b = find(supplier * 1000000), find(part)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in core.QUERIES["network_components"](spark, folder).collect()}
    assert got == {x: find(x) for x in root} and sum(c == 5000 for c in got.values()) == CHAIN + 1


def test_variants_of_all_documents(spark, lines):
    folder, rows, _ = lines
    docs, of = defaultdict(set), defaultdict(set)
    for o, _, s, _ in rows:
        key = f"n{s % 20}|{'abcd'[s % 2]}{s % 3}"
        docs[key].add(o)
        of[o].add(key)
    families = defaultdict(list)
    for key in docs:
        families[key[: key.index("|") + 2]].append(key)
    mates = {k: set().union(*(of[o] for o in d)) - {k} for k, d in docs.items()}
    want = set()
    for family, keys in families.items():
        if len(keys) > 1:
            main = max(keys, key=lambda k: (len(docs[k]), k))
            want |= {(family, k, len(docs[k]), 0 if k == main else len(mates[k] & mates[main])) for k in keys}
    assert {tuple(r) for r in core.QUERIES["author_variants"](spark, folder).select("family", "key", "n", "shared").collect()} == want
