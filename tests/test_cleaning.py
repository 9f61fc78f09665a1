import random

from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import citations, dedup, entities, filters, terms


def test_duplicates_by_doi_title_and_neighbourhood(spark):
    rng = random.Random(7)
    words = ["network", "growth", "citation", "index", "author", "model", "survey", "policy", "method", "theory", "impact", "graph"]
    titles = [" ".join(rng.choice(words) + str(rng.randint(10, 99)) for _ in range(9)) for _ in range(60)]
    rows = [(i, "", t, 2000 + i % 5, "lee", "f1") for i, t in enumerate(titles)]
    rows += [(100 + i, "", t[:-4] + "x" + t[-3:], 2000 + i % 5, "lee", "f2") for i, t in enumerate(titles[:0])]
    rows += [(200, "10.1/a", "first one of two", 2001, "a", "f1"), (201, "10.1/a", "another title", 2005, "b", "f2")]
    rows += [(300, "", "growth of the citation network in the south", 2001, "kim", "f1"), (301, "", "growth of the citation networc in the south", 2002, "kim", "f2")]
    rows += [(400, "", "annual survey part ii of the region north", 2001, "kim", "f1"), (401, "", "annual survey part iv of the region north", 2001, "kim", "f1")]
    rows += [(500, "10.1/x", "the same long title", 2001, "kim", "f1"), (501, "10.1/y", "the same long title", 2001, "kim", "f1"), (502, "", "the same long title", 2001, "kim", "f1")]
    items = spark.createDataFrame(rows, "rec long, doi string, title string, year int, surname string, file string")
    members, table = dedup.duplicate_groups(items)
    got = {tuple(sorted(r[0])) for r in members.groupBy("group").agg(F.collect_list("rec")).select("collect_list(rec)").collect()}
    assert got == {(200, 201), (300, 301), (500, 501, 502)}
    by = {r["group"]: r for r in table.collect()}
    assert by[200]["reason"] == "doi" and by[500]["doi_conflict"] and by[300]["similarity"] < 1


def test_survivors(spark):
    records = spark.createDataFrame([(1, "short", "", ["a"], 5), (2, "much longer", "10.1/x", ["a", "b"], None), (3, "mid text", "", [], 9)], "rec long, abstract string, doi string, kw array<string>, cited long")
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "group long, rec long")
    score = dedup.record_score(["abstract", "doi"], ["kw"])
    row = dedup.survivors(records, members, score, ["abstract"], ["doi"], ["kw"], ["cited"]).first()
    assert (row["base"], row["merged"], row["abstract"], row["doi"], row["kw"], row["cited"]) == (2, 3, "much longer", "10.1/x", ["a", "b"], 9)


def test_text_functions(spark):
    df = spark.createDataFrame([("Él ñandú, Ünïted! 12 a b-c", "https://doi.org/10.1002/(SICI)1097<1::AID>3.0.CO;2-A.", "in 1987-88")], "t string, d string, y string")
    row = df.select(tx.fold(df.t), tx.tokens(df.t), tx.norm_doi(df.d), tx.year_of(df.y), tx.slug(df.t), tx.split_list(F.lit("a; A;b ; ;c"))).first()
    assert row[0] == "el nandu, united! 12 a b-c" and row[1] == ["el", "nandu", "united", "b-c"]
    assert row[2] == "10.1002/(sici)1097<1::aid>3.0.co;2-a" and row[3] == 1987 and row[4] == "el-nandu-united-12-a-b-c" and row[5] == ["a", "b", "c"]


def test_bigrams_never_cross_a_stop_word(spark):
    df = spark.createDataFrame([(1, "growth of citation networks")], "doc long, text string")
    assert [r["term"] for r in terms.long_bigrams(df).collect()] == ["citation networks"]


def test_terms_and_synonyms(spark):
    rows = spark.createDataFrame([(1, "Networks"), (1, "networks"), (2, "NETWORKS"), (2, "graph"), (3, "the")], "doc long, term string")
    got = {r["term"]: (r["n"], r["label"]) for r in terms.term_counts(terms.clean_terms(rows, ["the"], {"graph": "networks"})).collect()}
    assert got["networks"][0] == 2 and "the" not in got
    counts = spark.createDataFrame([("co-citation", 2), ("cocitation", 3), ("graph", 1), ("graphs", 1), ("zebra", 1)], "term string, n long")
    groups = terms.synonym_suggestions(counts).groupBy("group").agg(F.sort_array(F.collect_list("term")).alias("t")).collect()
    assert sorted(r["t"] for r in groups) == [["co-citation", "cocitation"], ["graph", "graphs"]]


def test_institutions_and_sources(spark):
    df = spark.createDataFrame([("Dept Physics, Univ of Chile, Santiago, Chile",), ("Lab 3, National Research Council of X, Rome",), ("Acme Health Trust, Oslo",)], "a string")
    assert [r[0] for r in df.select(entities.institution_of(df.a)).collect()] == ["Univ of Chile", "National Research Council of X", "Acme Health Trust"]
    rows = spark.createDataFrame([("J Test", "1"), ("J Test", "1"), ("Journal of Tests", "1"), ("Other", "2"), ("No issn", None)], "name string, issn string")
    assert {r["name"]: r["source"] for r in entities.source_groups(rows).collect()} == {"J Test": "J Test", "Journal of Tests": "J Test", "Other": "Other", "No issn": "No issn"}
    assert entities.resolve_merges({"a": "b", "b": "c"}) == {"a": "c", "b": "c"}


def test_filters_treat_missing_as_failing(spark):
    docs = spark.createDataFrame([(1, 2000, "article", ["en"], "s", ["Física"], 3), (2, None, "article", [], "s", [], None)], "doc long, year long, doc_type string, languages array<string>, source string, areas array<string>, cited long")
    f = lambda **k: [r["doc"] for r in filters.apply_filters(docs, filters.Filters(**k)).collect()]
    assert f() == [1, 2] and f(year_from=1990) == [1] and f(languages=("none",)) == [2] and f(areas=("FISICA",)) == [1] and f(min_cited=0) == [1]


def test_reference_matching(spark):
    docs = spark.createDataFrame(
        [(1, "Smith", 1999, "Journal of Testing", "12", "34", "10.1/a", "", "A very long title about reference matching"), (2, "Johnson", 2001, "Physical Review", "3", "7", "", "", "Short"), (3, "Citing", 2010, "X", "", "", "", "", "T")],
        "doc long, surname string, year int, source string, volume string, first_page string, doi string, work_id string, title string",
    )
    refs = spark.createDataFrame(
        [(10, 3, "SMITH J", 1999, "J TEST", "12", "34", "", "", "SMITH J, 1999, J TEST, V12, P34"), (11, 3, "JOHNSEN P", 2001, "PHYS REV", "3", "7", "", "", "JOHNSEN P, 2001, PHYS REV, V3, P7"), (12, 2, "X", None, "", "", "", "10.1/a", "", "doi"), (13, 3, "SMITH J", 1999, "J TEST", "99", "34", "", "", "other volume")],
        "occ long, doc long, first_author string, year int, source string, volume string, page string, doi string, work_id string, raw string",
    )
    links = citations.local_citations(docs, refs)
    assert sorted((r["doc"], r["cited"], r["how"]) for r in links.collect()) == [(2, 1, "doi"), (3, 1, "reference"), (3, 2, "reference")]
    clusters = citations.reference_clusters(refs, spark.createDataFrame([(10, 1), (12, 1)], "occ long, cited long"))
    assert {r["occ"]: r["cluster"] for r in clusters.collect()} == {10: 10, 12: 10, 11: 11, 13: 13}
    nodes, edges = citations.historiograph(docs.withColumn("cited", F.lit(1)), links)
    assert {r["doc"] for r in nodes.collect()} == {1, 2} and [(r["src"], r["dst"]) for r in edges.collect()] == [(2, 1)]


def test_one_title_with_many_dois_and_records_set_apart(spark):
    rows = [(k, f"10.1/{k}", "letter to the editor", 2001, f"s{k % 7}", "f") for k in range(120)]
    rows += [(200, "", "letter to the editor", 2001, "s3", "f"), (201, "", "letter to the editor", 2001, "s33", "f"), (202, "10.1/5", "letter to the editor", 2001, "s5x", "f")]
    items = spark.createDataFrame(rows, "rec long, doi string, title string, year int, surname string, file string")
    ok = lambda a, b: not (a[1] and b[1] and a[1] != b[1]) and (a[4] in b[4] or b[4] in a[4])
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and ok(a, b)}
    assert {(r["src"], r["dst"]) for r in dedup.title_links(items).collect()} == want
    apart = spark.createDataFrame([(200,), (5,)], "rec long")
    members, _ = dedup.duplicate_groups(items, kept_apart=apart)
    assert not {200, 5} & {r["rec"] for r in members.collect()}
