import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontam, html_extract, langid, license_scan, mixing, ngram_join, pii, quality, toxicity, url_filter

EDGE = [(1, None, "x"), (2, "", "x"), (3, "one", "x"), (None, "null id here with several plain words in it.", "x"), (4, "again and again", "y"), (4, "again and again", "y"), (5, "long " * 40_000, "z")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, "en", 1.5, 7) for r in EDGE], "doc_id long, text string, source string, lang string, score double, n long")


@pytest.fixture(scope="module")
def none(edge):
    return edge.where("doc_id < -1")


LABELS = "doc_id long, quality int, toxic int"


# n-gram join ----------------------------------------------------------------------------


def classes_of(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    low = {i: i for i in sets}
    ids = sorted(sets)

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i in ids:
        for j in ids:
            a, b = sets[i], sets[j]
            if i < j and a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = root(i), root(j)
                low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.randint(20, 160))] for _ in range(12)]
    shared = [rng.choice(words) for _ in range(60)]
    out = []
    for i in range(n):
        b = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            b[rng.randrange(len(b))] = rng.choice(words)
        if i % 5 == 0:
            b = b[: rng.randint(1, 30)] + shared
        out.append((i * 7 % 1009, " ".join(b).upper() if i % 11 == 0 else " ".join(b)))
    return out


@pytest.mark.parametrize("group", [2560, 6])
def test_join_against_all_pairs(spark, group):
    texts = corpus(group)
    got = ngram_join.ngram_jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), group=group).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == classes_of(texts)


def test_join_edges(edge, none):
    rows = sorted(ngram_join.ngram_jaccard_components(edge).collect(), key=str)
    assert len(rows) == len(EDGE)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[None]["component_id"] is None and by[4]["component_id"] == 4
    assert by[5]["n_shingles"] == 1
    assert ngram_join.ngram_jaccard_components(none).count() == 0


def test_join_joins_the_texts_of_an_id(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (3, "a b c d e f")]
    got = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r[0], r[2]) for r in got} == {(1, 1), (2, 1), (3, 1)}


# licenses -------------------------------------------------------------------------------


def test_license_base_and_method(spark):
    rows = [(1, "Intro. Released under the MIT License."), (2, "mit  license, MIT-license; apache license"), (3, "License of the general public"), (4, "Redistribution and use in source and binary forms, with or without modification, are permitted"), (5, "Nothing here"), (6, None), (7, "émit license")]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["labels"]) == (1, 4, "mit") and got[1]["score"] == 1.0
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["base_labels"]) == (3, 0, 4, "apache,mit")
    assert got[3]["n_base"] == 0 and got[4]["labels"] == "bsd" and got[4]["base_labels"] == ""
    assert (got[5]["score"], got[6]["n_words"], got[6]["first_word"]) == (0.0, 0, None) and got[7]["n_base"] == 0


def test_license_edges(edge, none):
    assert license_scan.scan_licenses(edge).count() == len(EDGE)
    assert license_scan.scan_licenses(none).count() == 0


# quality --------------------------------------------------------------------------------


def brute_repeat(words):
    w = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, x in enumerate(w) if w.count(x) > 1 for k in range(5)}
    return len(hit)


def test_quality_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["\n".join(" ".join(rng.choice("ab c## d| é".split()) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 8))) for _ in range(80)]
    got = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if x.strip()]
        assert got[i]["n_words"] == len(words) and got[i]["word_chars"] == sum(map(len, words))
        assert got[i]["n_symbols"] == sum(c in "#*$%&|<>" for c in t) and got[i]["n_dup_lines"] == len(lines) - len(set(lines))
        assert got[i]["n_repeat_words"] == brute_repeat(words)


def test_quality_lines(spark, edge, none):
    good = "This is a plain sentence that has more than ten words in it, as you see."
    rows = [(1, f"{good}\nAccept all cookies\nHome » News » Sport"), (2, "a | b | c | d | e | f | g | h | i | j | k"), (3, good)]
    got = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == good and got[1]["n_good_lines"] == 1
    assert not got[2]["kept"] and got[3]["kept"]
    assert quality.judge_quality(edge).count() == len(EDGE) and quality.judge_quality(none).count() == 0


# URLs -----------------------------------------------------------------------------------


def brute_url(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, default=None)


@pytest.mark.parametrize("limit", [50_000, 0])
def test_urls_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    rules = [*url_filter.RULES, ("org", "/pri", "block"), ("a.org", "/private/x.html", "allow"), ("org", "", "allow")]
    urls = ["http://WWW.Example.com/en/1", "https://example.com/en", "http://example.com", "http://x.net/fr/?q", "http://x.net/fr", "http://net/es/#a", None, "nothing", "http://a.org/private/x.html?y", "http://b.org/prime", "http://c.org/", "http://adult-x.example.net/en/", "ftp://h.net/a://b.com/", "http:///es/", "http://xnet/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark, rules), url_filter.TERMS).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, best = brute_url(urls[r["page_id"]], rules)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[3] if best else None)
        if best and host:
            assert r["verdict"] == best[2]
    assert {r["page_id"]: r["verdict"] for r in got}[11] == "block"
    assert url_filter.judge_urls(pages.where("page_id < 0"), url_filter.rule_table(spark, []), []).count() == 0


# PII ------------------------------------------------------------------------------------


def test_permutation_is_a_bijection():
    p = pii.Permuter("k")
    for n in (2, 10, 97, 1000):
        assert sorted(p.number(x, n, "t") for x in range(n)) == list(range(n))
    assert len({p.word(f"{i:04d}", "t") for i in range(2000)}) == 2000


def test_surrogates_keep_type_and_are_consistent(spark):
    text = 'Mrs. Anna Müller met Mr. Иван Петров; Anna wrote to anna.m@mail.example.com from 10.1.2.3, +1 (415) 555-2671, card 4111 1111 1111 1111, ssn 123-45-6789, token = "0123456789abcdef0123456789abcdef01234567".'
    s = pii.Surrogates("k")
    out, counts, _ = s.replace(text)
    for own in ("Müller", "Anna", "Петров", "anna.m@mail", "10.1.2.3", "555-2671", "4111", "123-45-6789", "0123456789abcdef"):
        assert own not in out
    assert counts == {"name": 5, "email": 1, "ip": 1, "phone": 1, "card": 1, "ssn": 1, "secret": 1}
    assert out == pii.Surrogates("k").replace(text)[0] != pii.Surrogates("other").replace(text)[0]
    new = re.search(r"Mrs\. (\S+) (\S+) met Mr\. (\S+) (\S+); (\S+) wrote to (\S+) from (\S+), \+1 (\(\d{3}\) \d{3}-\d{4}), card ([\d ]{19}),", out)
    assert new and new[1] == new[5] and new[1] in pii.GIVEN["f"] and re.fullmatch("[А-я]+", new[4])
    assert pii.luhn(new[9].replace(" ", "")) and new[7].startswith(("10.", "127.", "192.168.", "172."))


def test_distinct_entities_stay_distinct():
    s = pii.Surrogates("k")
    out, _, _ = s.replace(" ".join(f"u{i}@h{i % 7}.example.com" for i in range(500)))
    assert len(set(out.split())) == 500


def test_pii_edges(edge, none):
    assert pii.pseudonymize(edge).count() == len(EDGE) and pii.pseudonymize(none).count() == 0
    assert pii.replace_in(edge, size_col="n").schema == edge.schema


# toxicity -------------------------------------------------------------------------------


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(0)
    rows, at, y = [], [], []
    for i in range(600):
        a, b = i % 2, (i // 2) % 2
        noise = rng.integers(2, 12, 3)
        own = sorted({*([0] if a else []), *([1] if b else []), *noise.tolist()})
        rows += [i] * len(own)
        at += own
        y.append(float(a and b))
    m = toxicity.FactorizationMachine(np.arange(12)).fit(np.array(rows), np.array(at), np.array(y), epochs=120)
    raw = m.raw(np.array([0, 1, 2, 2]), np.array([0, 1, 0, 1]), 3)
    assert raw[0] < 0 and raw[1] < 0 and raw[2] > 0


def test_toxicity_end_to_end(spark, edge, none):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(30)) + (" nastyword" if i % 4 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in docs] + [(None, 1, 1), (1, None, None)], LABELS)
    m = toxicity.fit_toxicity(df, labels)
    got = toxicity.score_toxicity(df, m).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got)
    assert {r["held_out"] for r in got} == {True, False}
    assert toxicity.drop_toxic(df, m).count() == 300 and toxicity.drop_toxic(df, m).schema == df.schema
    assert toxicity.score_toxicity(edge, m).count() == len(EDGE) and toxicity.score_toxicity(none, m).count() == 0
    empty = toxicity.fit_toxicity(none, labels.where("doc_id < 0"))
    assert toxicity.score_toxicity(edge, empty).where("score != 0.5").count() == 0


# decontamination ------------------------------------------------------------------------

ITEM = "Alice bought 12 apples and 5 kg of pears at the market, then Bob sold 3 of the apples to a neighbour for 7 dollars."


def test_templates(spark, edge, none):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, ITEM)], "item_id long, text string")
    other = ITEM.replace("12", "40").replace("5 kg", "9 kg").replace("Bob", "Carla").replace("3 of", "8 of").replace("7 dollars", "2 dollars")
    torn = "At noon 1 of 2 friends bought 12 apples and pears in the rain and went home again."
    docs = [(1, "Before it all.\n" + ITEM + "\nAfter."), (2, "Some words first. " + other), (3, torn), (4, "Unrelated words about the weather in the north of the country today."), (5, None)]
    got = {r["doc_id"]: r for r in decontam.mark_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert [got[i]["contaminated"] for i in (1, 2, 3, 4, 5)] == [True, True, False, False, False] and got[1]["item_id"] == 1
    assert decontam.mark_contaminated(edge, items).where("contaminated").count() == 0
    assert decontam.mark_contaminated(edge, items.where("item_id < 0")).count() == len(EDGE) and decontam.mark_contaminated(none, items).count() == 0
    assert decontam.drop_contaminated(edge, items).count() == len(EDGE)


def test_inconsistent_slots_do_not_match(spark):
    item = "the sum of 4 and 4 and 4 and 4 makes the number 16 for every 4 that you see in the row of 4 digits"
    swapped = "the sum of 1 and 2 and 3 and 5 makes the number 11 for every 6 that you see in the row of 7 digits"
    docs = spark.createDataFrame([(1, swapped), (2, item.replace("4", "9"))], "doc_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontam.mark_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: False, 2: True}


# HTML -----------------------------------------------------------------------------------


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a>Home</a></nav><div class="ad">Buy</div>
    <main><article><h1>Head &amp; more</h1><p>One<br>two <b>bo</b>ld &eacute;<p>Three<script>var x = "</p>";</script></p><aside>side</aside><form><p>mail</p></form><ul><li>item</li></ul>
    <section id="comments"><article><p>first!</p></article></section></article></main><footer>&copy; x</footer></body></html>"""
    text = lambda x: html_extract.main_lines(*html_extract.lines_of(x))
    assert text(page) == ["Head & more", "One two bold é", "Three", "item"]
    assert text("") == [] and text("<p>a<div class='cookie notice'>c</div><p hidden>h</p>b<") == ["a", "b<"]
    assert text("<article><p>cut off &am") == ["cut off &am"]
    assert text("<article><div class='article-header'><h1>T</h1></div><p>x <math>y</math></p><div class='site-header'>no</div></article>") == ["T", "x y"]


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        got = html_extract.shared_lines(a, b)
        assert len(got) == brute_lcs(a, b)
        it = iter(b)
        assert all(x in it for x in [a[i] for i in sorted(got)])


def test_pages_without_article_are_differenced(spark, edge, none):
    page = lambda own: f"<html><body><div>Welcome to the site</div><p>{own}</p><div>All about us</div></body></html>"
    rows = [(1, "http://h.com/a/1", page("own one")), (2, "http://h.com/a/2", page("own two")), (3, "http://other.com/x", page("lone")), (4, None, None), (2, "http://h.com/a/2", page("own two"))]
    got = {r["page_id"]: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "own one" and got[2]["text"] == "own two" and got[3]["n_shared"] == 0 and got[4]["text"] == ""
    assert html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").where("page_id < 0")).count() == 0


# language -------------------------------------------------------------------------------

LINES = {"en": "the people of the town were in the house and they said that it was good", "de": "die leute der stadt waren in dem haus und sie sagten dass es gut war", "fr": "les gens de la ville étaient dans la maison et ils ont dit que c'était bon"}


def test_language(spark, edge, none):
    rng = random.Random(0)
    docs = []
    for i in range(120):
        lang = rng.choice(list(LINES))
        docs.append((i, " ".join(rng.sample(LINES[lang].split(), 9)), lang, f"src-{lang}"))
    docs += [(500, None, None, None), (501, "", "en", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(1, "http://a.de/x", "<html lang='de'><p>ok</p></html>"), (2, None, None), (3, "http://b.fr/", "<html lang=\"fr-FR\"><body>les gens de la ville</body></html>")], "page_id long, url string, html string")
    model = langid.fit_text_model(d)
    got = langid.identify(langid.rows_of(pages, d), model, ["doc_id", "page_id"]).collect()
    assert len(got) == len(docs) + 3
    assert all(r["lang"] == docs[r["doc_id"]][2] for r in got if r["doc_id"] is not None and r["doc_id"] < 120)
    assert {r["page_id"]: r["lang"] for r in got if r["page_id"]}[3] == "fr"
    assert langid.identify(langid.rows_of(pages, d), langid.fit_text_model(none), ["page_id"]).where("lang != 'und'").count() == 0


# mixing ---------------------------------------------------------------------------------


def test_rates_meet_the_targets(spark):
    p = np.array([[0.9, 0.1], [0.2, 0.8], [0.5, 0.5], [0.97, 0.03]])
    t = [100, 40, 10, 300]
    cells = spark.createDataFrame([(int(n), [float(x) for x in row]) for n, row in zip(t, p, strict=True)], "tokens long, p array<double>")
    rate, reached = mixing.fit_rates(cells, 2, [1.0, 1.0])
    assert np.allclose(reached, [225, 225], rtol=0.01)
    r = np.array([x[0] for x in cells.select(rate).collect()])
    assert (r >= 0).all()
    far, reached = mixing.fit_rates(cells, 2, [0.0, 1.0])  # cannot be met: no cell is all of the second domain
    r = np.array([x[0] for x in cells.select(far).collect()])
    assert (r >= 0).all() and reached[1] > reached[0]


def test_mixing_edges(spark, edge, none):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 0, 0), (None, 1, 0), (99, 1, 0), (2, None, 0)], LABELS)
    out = mixing.mix_to_targets(edge, mixing.domains_from(edge, labels), mixing.target_weight)
    assert out.count() == len(EDGE) and out.where("_rate is null or _rate < 0").count() == 0
    assert mixing.mix_to_targets(none, mixing.domains_from(none, labels), mixing.target_weight).count() == 0
    plain = mixing.mix_to_targets(edge, mixing.domains_from(edge, labels.where("false")), mixing.target_weight)
    assert plain.where("_rate != 1 or _copies != 1").count() == 0
