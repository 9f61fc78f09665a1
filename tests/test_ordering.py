import random

from quillon.operators.ordering import dense_ranks, numbered, running_sums
from quillon.store import Stages


def test_numbers_by_group_with_a_hot_tie(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), 5 if rng.random() < 0.5 else rng.randint(0, 40)) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(7)
    got = numbered(df, ["v"], Stages(spark, "t"), "n", ["g"], size="of").collect()
    for g in "ab":
        mine = sorted((r["index"], r["v"]) for r in got if r["g"] == g)
        assert [i for i, _ in mine] == list(range(len(mine)))
        assert [v for _, v in mine] == sorted(v for h, v in rows if h == g)
        assert {r["of"] for r in got if r["g"] == g} == {len(mine)}


def test_dense_ranks_and_running_sums(spark):
    rows = [(i * 7 % 13, i) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    order = {k: n + 1 for n, k in enumerate(sorted({k for k, _ in rows}))}
    assert {(r["k"], r["rank"]) for r in dense_ranks(df, ["k"], Stages(spark, "t"), "d").collect()} == set(order.items())
    got = sorted(running_sums(df, ["v"], {"k": "total"}, Stages(spark, "t"), "s", to="no").collect(), key=lambda r: r["v"])
    total = 0
    for n, r in enumerate(got):
        total += r["k"]
        assert (r["no"], r["total"]) == (n + 1, total)
    assert running_sums(df.where("k < 0"), ["v"], {"k": "total"}, Stages(spark, "t"), "s").count() == 0
