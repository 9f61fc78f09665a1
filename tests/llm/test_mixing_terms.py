import random

from quillon.llm import mixing

WORDS = {
    "cooking": "flour butter oven salt pepper onion garlic sauce bread dough simmer whisk".split(),
    "stars": "orbit comet nebula galaxy planet lens eclipse quasar meteor rocket crater lunar".split(),
    "russian": "дом река книга город снег поле небо утро вечер дорога лес камень".split(),
    "italian": "casa fiume libro cane neve campo cielo mattina sera strada bosco pietra".split(),
    "chinese": "山水火土木金日月星风雨雪",
}
TARGET = {"cooking": 3.0, "stars": 1.0, "russian": 1.0, "italian": 2.0, "chinese": 1.0}


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(300):
        topic = sorted(WORDS)[i % 5]
        words = [rng.choice(WORDS[topic]) for _ in range(rng.randint(15, 40))]
        rows.append((i, (" " if topic != "chinese" else "").join(words), topic))
    return rows


def test_labels_of_any_kind_are_learned(spark, caplog):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labelled = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3], "doc_id long, domain string")
    with caplog.at_level("INFO", logger=mixing.__name__):
        out = {r["doc_id"]: r for r in mixing.mix_to_targets(docs, labelled, TARGET.get).collect()}
    assert {i: r["_domain"] for i, r in out.items()} == {i: topic for i, _, topic in rows}
    tokens = {t: sum(out[i]["_rate"] * out[i]["_tokens"] for i, _, topic in rows if topic == t) for t in WORDS}
    whole = sum(len(t.split()) for _, t, _ in rows)
    assert all(abs(tokens[t] - TARGET[t] / 8 * whole) < 0.02 * whole for t in WORDS)
    assert "residual" in caplog.text and "settled: True" in caplog.text


def test_posteriors_follow_the_terms_of_the_text(spark):
    """A text of both topics, in equal shares or not, has a posterior of its own; copies share theirs."""
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "alpha gamma"), (4, "alpha beta gamma"), (5, "alpha beta gamma"), (6, "unseen"), (7, None)], "doc_id long, text string")
    from quillon.store import Stages

    stages = Stages(spark, "test")
    rows = docs.select("doc_id", *mixing.text_keys(docs.text), mixing.F.lit(1).cast("long").alias("tokens"), mixing.terms_of(docs.text).alias("terms"))
    model = mixing.fit_domains(rows, spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, domain string"), stages)
    keyed = docs.select("doc_id", *mixing.text_keys(docs.text))
    p = {r["doc_id"]: r["p"][0] for r in keyed.join(model.cells(rows), ["_k1", "_k2"]).collect()}
    assert p[1] > p[4] > p[3] > p[2] and p[4] == p[5]
    assert abs(p[3] - 0.5) < 1e-9 and abs(p[6] - 0.5) < 1e-9 and abs(p[7] - 0.5) < 1e-9
    assert model.cells(rows).where("tokens = 2").count() == 1
