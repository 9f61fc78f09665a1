"""The whole way from export files to tables, and the rules of cleaning."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.highlight import highlight, highlight_terms
from quillon.operators import cleaning, dedup, filters, indicators, networks
from quillon.sources.reader import read_bib
from quillon.sources.synonyms import synonyms_from_csv, synonyms_to_csv

CSV = """Authors,Title,Year,Source title,Cited by,DOI,Abstract,Affiliations,Authors with affiliations,ISSN,Document Type
"Doe, J.; Pérez, M.","Salt and the sea plants of the north",2001,JOURNAL OF SALT,3,10.1234/a,,"UNIV DAVIS, Davis, United States; Inst Biol, Lima, Peru","Doe, J., UNIV DAVIS, Davis, United States; Pérez, M., Inst Biol, Lima, Peru",1234-5678,Article
"Doe, J.;","Another study of the salt plants",2003,Journal of Salt,,10.1234/b,,"Univ Davis, Davis, United States","Doe, J., Univ Davis, Davis, United States",,Review
"""
RIS = """TY  - JOUR
AU  - Doe, J.
TI  - Salt and the Sea Plants of the North
PY  - 2001
T2  - J Salt
SN  - 1234-5678
DO  - 10.1234/A
AB  - A long abstract.
ER  -
TY  - JOUR
AU  - Lone, A.
TI  - Nothing to do with it at all, really
PY  - 2005
ER  -
"""


@pytest.fixture(scope="module")
def cleaned(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("import")
    for sub, name, text in (("a", "x.csv", CSV), ("b", "x.ris", RIS), ("c", "x.csv", CSV.replace("10.1234/b", "10.1234/c").replace("Another study", "One more and quite other study").split("\n")[0] + "\n")):
        (folder / sub).mkdir()
        (folder / sub / name).write_text(text)
    return cleaning.clean(read_bib(spark, f"{folder}/*/*"))


def test_merged_records(cleaned):
    stats = cleaned.stats().first().asDict()
    assert stats == {"identified": 4, "groups": 1, "duplicates_removed": 1, "unique": 3, "filtered_out": 0, "screening": 3, "shown": 3}
    one = cleaned.records.where("merged = 2").first()
    assert (one["doi"], one["timesCited"], one["abstract"], one["docType"]) == ("10.1234/a", 3, "A long abstract.", "article")
    assert set(one["merge_log"]) == {"abstract"} and one["countries"] == ["peru", "united states"]
    assert one["source_name"] == "Journal of Salt"


def test_names_of_places_and_people(cleaned):
    _, labels = cleaning.collaboration_lists(cleaned, "institutions")
    assert {r["label"] for r in labels.collect()} == {"University Davis", "Institute Biology"}
    inc, labels = cleaning.collaboration_lists(cleaned, "authors")
    edges = networks.cooccurrence(inc).collect()
    names = {r["item"]: r["label"] for r in labels.collect()}
    assert [(names[e["src"]], names[e["dst"]]) for e in edges] == [("Doe J", "Pérez M")]
    table = {r["institution"]: (r["documents"], r["appearances"], r["country"]) for r in cleaning.institutions_table(cleaned).collect()}
    assert table == {"University Davis": (2, 2, "united states"), "Institute Biology": (1, 1, "peru")}
    first, second, basis = cleaning.countries_tables(cleaned)
    assert {(r["country"], r["documents"], r["scp"], r["mcp"]) for r in first.collect()} == {("united states", 2, 1, 1)}
    assert {(r["country"], r["appearances"], r["documents"]) for r in second.collect()} == {("united states", 2, 2), ("peru", 1, 1)}
    assert {r["basis"]: r["n"] for r in basis.collect()} == {"firstAuthor": 2, "none": 1}
    assert {(r["country"], r["partners"], r["top"]) for r in cleaning.country_partners(cleaned).collect()} == {("united states", 1, "peru"), ("peru", 1, "united states")}


def test_indicators_of_read_records(cleaned):
    h = {r["source"]: r["h"] for r in indicators.h_index(cleaned.docs.where("source is not null")).collect()}
    assert h == {"Journal of Salt": 1}
    assert indicators.annual(cleaned.docs, 2005).count() == 5
    assert cleaned.authors.count() == 4 and cleaned.docs_with_countries.count() == 3


def test_institution_names(spark):
    rows = [("UNIV DE LA PLATA",), ("Natl Inst Agric.",), ("[Doe, J.] Univ Calif",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(cleaning.normalize_institution(F.col("x"))).collect()]
    assert got == ["University de la Plata", "National Institute Agricultural", "University Calif", ""]


def test_planted_duplicates(spark):
    """60 of 60 among 3,000 titles, and no false group, whatever the ranges and openings."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9))) for _ in range(800)]
    titles = ["the effect of " + " ".join(rng.choice(words) for _ in range(9)) for _ in range(3000)]
    rows = [(i, "", t, 2000, "", "f1") for i, t in enumerate(titles)]
    for k in range(60):
        t = list(titles[k * 50])
        t[rng.randrange(len(t) // 2, len(t)) if k % 2 else rng.randrange(0, 8)] = "z"
        rows.append((10_000 + k, "", "".join(t), 2000, "", "f2"))
    items = spark.createDataFrame(rows, "rec long, doi string, title string, year int, surname string, file string").repartition(13)
    members, groups = dedup.duplicate_groups(items)
    by = {}
    for r in members.collect():
        by.setdefault(r["group"], set()).add(r["rec"])
    assert sorted(map(sorted, by.values())) == sorted([k * 50, 10_000 + k] for k in range(60)) and groups.count() == 60


def test_common_title_with_many_surnames(spark):
    rows = [(i, "", "editorial of the journal", 2000, f"name{i:03d}x" if i else "", "f") for i in range(40)]
    items = spark.createDataFrame(rows, "rec long, doi string, title string, year int, surname string, file string")
    assert dedup.title_links(items).count() == 39
    assert dedup.title_links(items.where("rec > 0")).count() == 0


def test_prisma_numbers(spark):
    documents = spark.createDataFrame([(i,) for i in range(10)], "key long")
    rows = [(0, "include", None), (1, "maybe", None), (2, "exclude", None), (3, "exclude", "notRetrieved"), (4, "exclude", "topic"), (4, "include", None), (99, "include", None)]
    got = filters.prisma_numbers(documents, spark.createDataFrame(rows, "key long, decision string, reason string"), F.col("documents") + 3, registers=2, duplicates=5).first().asDict()
    assert (got["identified"], got["screened"], got["sought"], got["assessed"], got["reports_excluded"], got["pending"], got["balanced"]) == (15, 10, 9, 8, 1, 6, True)


def test_synonyms_and_marks(spark):
    rows = [("plant, green", "plant"), ('say "no"', "no")]
    assert synonyms_from_csv(synonyms_to_csv(rows)) == rows and synonyms_from_csv("Término;x\na;b\n;c\n") == [("a", "b")]
    assert highlight_terms("salt stress, sea; salt stress\nx") == ["salt stress", "sea"]
    texts = ["Él vio SALT, salty.", "the sea", None, "", "İ salt-stress test é", "salt stress test"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(highlight(F.col("t"), ["salt", "el", "stress test", "salt stress", "sea"]).alias("x")).collect()
    assert [[(p["text"], p["mark"]) for p in r["x"]] for r in got] == [
        [("Él", True), (" vio ", False), ("SALT", True), (", salty.", False)], [("the ", False), ("sea", True)], [], [],
        [("İ ", False), ("salt", True), ("-", False), ("stress test", True), (" é", False)], [("salt stress test", True)],
    ]


def test_summary_table_of_a_biomedical_export():
    from quillon.sources.parsers import parse_text

    text = 'PMID,Title,Authors,Citation,Journal/Book,Publication Year,DOI\n77,"On salt","Doe J, Pérez M.","J Salt. 2001 Mar;12(3):45-9. doi: 10.1234/z.",J Salt,2001,\n'
    _, rows, _ = parse_text("x.csv", text)
    r = rows[0]
    assert (r["originId"], r["volume"], r["issue"], r["pages"], r["year"], r["doi"], [a["short"] for a in r["authors"]]) == ("77", "12", "3", "45-9", 2001, "10.1234/z", ["Doe J", "Pérez M"])


def test_short_names_of_references(spark):
    from quillon.operators.analysis import reference_analysis, reference_short

    rows = [("Smith J", 2001, "Nature", "7", "391", "", "x"), ("Smith J", 2001, "Nature", "", "", "10.1/y", "y"), ("Doe A", 1999, "", "", "", "", "z"), ("", None, "", "", "", "", "w " * 80)]
    got = [r["short"] for r in reference_short(spark.createDataFrame(rows, "first_author string, year int, source string, volume string, page string, doi string, label string")).orderBy("label").collect()]
    assert got[1:] == ["Smith J, 2001, Nature, 7:391", "Smith J, 2001, Nature, 10.1/y", "Doe A, 1999"] and len(got[0]) <= 90 and got[0].endswith("…")
    docs = spark.createDataFrame([(1, "Smith", 2001, "Nature", "7", "391", "10.1/a", "", "On salt plants of the sea"), (2, "Doe", 2005, "Cell", "1", "1", "", "", "Other")], "doc long, surname string, year int, source string, volume string, first_page string, doi string, work_id string, title string")
    refs = spark.createDataFrame([(1, 2, "Smith J", 2001, "Nature", "7", "391", "10.1/a", "", "Smith J, 2001"), (2, 2, "Smith, J.", 2001, "Nature", "7", "391", "", "", "Smith, On salt plants of the sea")], "occ long, doc long, first_author string, year int, source string, volume string, page string, doi string, work_id string, raw string")
    links, clusters = reference_analysis(docs, refs)
    assert [(r["doc"], r["cited"], r["how"]) for r in links.collect()] == [(2, 1, "doi")] and {r["cluster"] for r in clusters.collect()} == {1}
