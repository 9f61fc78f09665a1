import random

import numpy as np

from quillon.llm import toxicity


def test_terms_that_tell_only_together(spark):
    """Each of four words is as frequent in toxic as in clean texts; two of them together decide. End to end."""
    rng = random.Random(8)
    filler = [f"filler{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(1600):
        words = [rng.choice(filler) for _ in range(12)]
        first, second = rng.choice(["wug", "blick"]), rng.choice(["dax", "norp"])
        if i % 5:
            words += [first, second]
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 > 0 and (first == "wug") == (second == "dax"))))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.95


def test_ratio_against_counts():
    y = np.array([1, 1, 0, 0, 0, 1])
    x = np.array([1, 1, 0, 0, 1, 1])
    every = [[np.sum((x == a) & (y == b)) for b in (0, 1)] for a in (0, 1)]
    total = sum(o * np.log(o * len(y) / (sum(every[a]) * (every[0][b] + every[1][b]))) for a in (0, 1) for b in (0, 1) if (o := every[a][b]))
    assert np.isclose(toxicity._ratio(np.array([3.0]), np.array([4.0]), 3.0, 6.0)[0], 2 * total)


def test_an_id_on_many_rows_teaches_once(spark):
    docs = spark.createDataFrame([(1, f"bad {i}") for i in range(300)] + [(i, "good words") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i == 1)) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    machine = toxicity.fit_toxicity(docs, labels)
    assert toxicity.score_toxicity(docs, machine).count() == docs.count()
