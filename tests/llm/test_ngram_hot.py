import random

import pytest

from quillon.llm import ngram_join


def brute(texts, shingle, threshold):
    sets = {}
    for i, t in texts:
        w = t.split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if i < j and a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = root(i), root(j)
                low[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("shingle", "threshold", "hot"), [(5, 80, 1), (3, 90, 3), (5, 80, 10**6)])
def test_near_clusters_against_all_pairs(spark, shingle, threshold, hot):
    """Clusters around the threshold, split into small groups, with frequent members taken without a count."""
    rng = random.Random(shingle * hot)
    words = [f"v{i}" for i in range(90)]
    texts = []
    for base in range(3):
        own = [rng.choice(words) for _ in range(80 + 40 * base)]
        for k in range(70):
            b = list(own)
            for _ in range(rng.randint(0, 5)):
                b[rng.randrange(len(b))] = rng.choice(words)
            texts.append((base * 1000 + k * 13 % 997, " ".join(b[: len(b) - rng.randint(0, 12)])))
    texts = list(dict(texts).items())
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = ngram_join.ngram_jaccard_components(frame, threshold=threshold, shingle=shingle, group=9, hot_rows=hot).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(texts, shingle, threshold)


def test_repeated_rows_of_one_id(spark):
    rows = [(1, "a b c d e f g h")] * 40 + [(2, "a b c d e f g h i")] * 3 + [(3, "a b c d e f g h")]
    got = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), threshold=80)
    assert got.count() == len(rows) and {r["component_id"] for r in got.collect()} == {1}
