import html
import random

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import langid

LINES = {"en": "the people of the town were in the house and they said that it was good", "de": "die leute der stadt waren in dem haus und sie sagten dass es gut war", "fr": "les gens de la ville étaient dans la maison et ils ont dit que c'était bon"}


@pytest.mark.parametrize("key", ["suffix", "declared"])
def test_values_of_the_tail_count(spark, key):
    """A value that 1,010 others outnumber is evidence as well."""
    texts = list(LINES.items())
    docs = spark.createDataFrame([(i, texts[i % 3][1], texts[i % 3][0], "s") for i in range(60)], "doc_id long, text string, lang string, source string")
    rows = [(None, texts[(k + j) % 3][1], f"v{k}") for k in range(1010) for j in range(6)]
    rows += [(None, LINES["de"], "tail") for _ in range(5)] + [(1, "", "tail"), (2, "", None)]
    df = spark.createDataFrame(rows, f"id long, text string, {key} string")
    for c in {"suffix", "declared", "host"} - {key}:
        df = df.withColumn(c, langid.F.lit(None).cast("string"))
    got = {r["id"]: r for r in langid.identify(df, langid.fit_text_model(docs), ["id"]).where("id is not null").collect()}
    assert got[1]["score"] > 0.6 > 0.4 > got[2]["score"]
    assert got[1]["lang"] in ("de", "und")


def test_fusion_against_brute_force(spark):
    """Scores of all rows from plain loops over the other rows; repeated rows, nulls, ties, clashing names."""
    rng = random.Random(2)
    texts = list(LINES.items())
    docs = spark.createDataFrame([(i, texts[i % 3][1], texts[i % 3][0], "s") for i in range(60)], "doc_id long, text string, lang string, source string")
    words = " ".join(LINES.values()).split()
    rows = []
    for i in range(80):
        text = rng.choice([None, "", "123", " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))), "&eacute;t&eacute; &agrave; la maison"])
        rows.append((i, text, rng.choice([None, "en", "de-AT", "FR"]), rng.choice([None, "com", "de"]), rng.choice([None, "a.x.de", "b.x.de", "y.com", "lone"]), rng.random() < 0.5, 0.5))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string, markup boolean, ll double")
    model = langid.fit_text_model(docs)
    n = len(model.langs)
    own = [html.unescape(r[1]) if r[1] and r[5] else r[1] for r in rows]
    ll = model.likelihood(pa.array(own, pa.string()))
    p = langid._softmax(ll + np.log(model.prior))
    total = p.sum(0) + 1
    base = total / total.sum()
    norm = lambda x: None if x is None else x.lower().split("-")[0]
    parent = lambda h: ".".join(h.split(".")[-2:]) if "." in h else ""
    want = []
    for i, r in enumerate(rows):
        score = ll[i] + np.log(model.prior)
        for k in (2, 3):
            if r[k] is not None:
                same = [j for j, o in enumerate(rows) if norm(o[k]) == norm(r[k]) and j != i]
                score = score + np.log((p[same].sum(0) + 0.5) / (total - p[i]))
        if (h := r[4]) is not None:
            up = base
            for of in (lambda x: x.split(".")[-1], parent, lambda x: x):
                mass = p[[j for j, o in enumerate(rows) if o[4] is not None and of(o[4]) == of(h) and j != i]].sum(0)
                up = (mass + langid.STRENGTH * up) / (mass.sum() + langid.STRENGTH)
            score = score + np.log(up / model.prior)
        e = np.exp(score - score.max())
        want.append((r[0], 1 / e.sum()))
    got = sorted((r["id"], r["score"]) for r in langid.identify(df, model, ["id"]).collect())
    assert n == 3 and [g[0] for g in got] == sorted(w[0] for w in want)
    assert all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(got, sorted(want), strict=True))
