import pytest

from quillon.functions.text import latex_text
from quillon.plans import strategy
from quillon.sources import catalogue, parsers, people, reader, writers

TAGGED2 = """FN Index
VR 1.0
PT J
AU Garcia, AM
   van Dyk, P
AF Garcia, Ana Maria
   van Dyk, Piet
TI A study of networks
   and their growth
SO JOURNAL OF TESTS
DE networks; growth
C1 [Garcia, Ana Maria] Univ Chile, Dept Phys, Santiago, Chile.
   [van Dyk, Piet] Leiden Univ, Leiden, Netherlands.
CR SMITH J, 1999, J TEST, V12, P34, DOI 10.1000/ABC
PY 2015
TC 7
DI 10.1234/xyz.5
DT Article
LA English
ER
EF
"""
TAGGED4 = """PMID- 123
TI  - Effects of tea.
LID - 10.5555/tea [doi]
FAU - Lee, Kim
AU  - Lee K
AD  - Seoul Natl Univ, Seoul, Republic of Korea.
JT  - Tea journal
DP  - 2019 Mar
MH  - *Tea/chemistry
LA  - eng
PT  - Review
"""
RIS = "TY  - JOUR\nTI  - Un titulo\nAU  - Pérez, J.\nPY  - 2011\nN2  - El resumen de la obra\nAB  - The abstract of the work\nSP  - 1\nEP  - 9\nDO  - https://doi.org/10.1000/r.1\nER  - \n"
BIB = """@string{jt = "Journal of " # {Tests}}
@comment{ignored @article{x, title={no}}}
@article{k1, title = {The {B}ig \\'{e}tude}, author = {M{\\"u}ller, Hans and {World Health Organization}}, journal = jt, year = 2001, month = jan, pages = {1--9}}
"""
CSV = '﻿Authors,Title,Year,Source title,Cited by,EID,References,"Authors with affiliations"\r\n"Diaz, L. (12345678); Roe, P.","A ""quoted"" title, with\nbreak",2010,Test J,,2-s2.0-1,"Smith J., Old work (1999) J Test, 12, pp. 34-40; Roe P., Other (2001) X, 1","Diaz, L., Univ of X, Madrid, Spain; Roe, P., Inst Y, Paris, France"\r\n'


@pytest.mark.parametrize("name,text,form", [("a.txt", TAGGED2, "tagged2"), ("a.txt", TAGGED4, "tagged4"), ("a.txt", RIS, "ris"), ("a.txt", BIB, "bibtex"), ("a.csv", CSV, "csv")])
def test_formats_are_told_by_content(name, text, form):
    assert parsers.detect(name, text) == form


def test_two_letter_tags():
    _, (r,), dropped = parsers.parse_text("x.txt", TAGGED2)
    assert dropped == 0 and r["title"] == "A study of networks and their growth"
    assert [a["last"] for a in r["authors"]] == ["Garcia", "van Dyk"] and r["authors"][1]["country"] == "netherlands"
    assert (r["year"], r["timesCited"], r["doi"], r["docType"], r["languages"]) == (2015, 7, "10.1234/xyz.5", "article", ["en"])
    assert r["references"][0] | {"raw": ""} == {"raw": "", "firstAuthor": "SMITH J", "year": 1999, "source": "J TEST", "volume": "12", "page": "34", "doi": "10.1000/abc"}
    assert r["countries"] == ["chile", "netherlands"]


def test_four_letter_tags():
    _, (r,), _ = parsers.parse_text("x.nbib", TAGGED4)
    assert (r["title"], r["doi"], r["timesCited"], r["docType"]) == ("Effects of tea", "10.5555/tea", None, "review")
    assert r["authors"][0]["country"] == "south korea" and r["indexKeywords"] == ["Tea"]


def test_ris_takes_the_english_abstract():
    _, (r,), _ = parsers.parse_text("x.ris", RIS)
    assert (r["abstract"], r["pages"], r["doi"], r["timesCited"]) == ("The abstract of the work", "1-9", "10.1000/r.1", None)


def test_bibtex_macros_accents_and_corporate_authors():
    _, (r,), _ = parsers.parse_text("x.bib", BIB)
    assert (r["title"], r["source"], r["year"], r["pages"]) == ("The Big étude", "Journal of Tests", 2001, "1-9")
    assert [a["last"] for a in r["authors"]] == ["Müller", "World Health Organization"]
    assert latex_text(r"na\"{\i}ve {\O}re \& co") == "naïve Øre & co"


def test_csv_quotes_and_missing_citations():
    _, (r,), _ = parsers.parse_text("x.csv", parsers.decode(CSV.encode())[0])
    assert r["title"] == 'A "quoted" title, with break' and r["timesCited"] == 0
    assert [a["country"] for a in r["authors"]] == ["spain", "france"] and r["authors"][0]["id"] == "12345678"
    assert [(x["year"], x["source"], x["page"]) for x in r["references"]] == [(1999, "J Test", "34"), (2001, "X", "")]


def test_decode_and_separators():
    assert parsers.decode("é".encode("utf-16-le").join([b"\xff\xfe", b""])) == ("é", "utf-16-le")
    assert parsers.decode(b"\xe9") == ("é", "latin1")
    assert parsers.sniff_separator('"a;b;c",d,e') == "," and parsers.sniff_separator("a;b") == ";"


def test_names():
    assert people.person("Smith JR")["initials"] == "JR"
    assert people.person("Juan de la Cruz")["last"] == "de la Cruz"
    assert people.person("King, Martin Luther, Jr.")["suffix"] == "Jr"
    assert people.country_of("Harvard Univ, Cambridge, MA 02138") == "united states"
    assert people.doc_type("Review; Article") == "review"


def test_read_bib_isolates_files(spark, tmp_path):
    for name, text in {"a.txt": TAGGED2, "b.bib": BIB, "c.ris": RIS, "empty.csv": "\n"}.items():
        (tmp_path / name).write_text(text)
    rows = reader.read_bib(spark, str(tmp_path)).cache()
    assert reader.records_only(rows).count() == 3
    assert {r["file"]: r["warnings"] for r in reader.file_catalogue(rows).collect()}["empty.csv"] == ["empty"]
    fill = {r["field"]: r["filled"] for r in reader.completeness(reader.records_only(rows)).collect()}
    assert fill["title"] == 3 and fill["timesCited"] == 1
    text = "".join(r["value"] for r in writers.bibtex(reader.with_ids(reader.records_only(rows))).collect())
    again = {r["title"] for r in parsers.parse_text("x.bib", text)[1]}
    assert again == {"A study of networks and their growth", "The Big étude", "Un titulo"}


def test_catalogue_pages_retries_and_maps(spark):
    calls = []

    def fetch(url):
        calls.append(url)
        if len(calls) == 1:
            raise catalogue.Busy
        return {"results": [{"id": f"W{len(calls)}"}], "meta": {"next_cursor": "n" if len(calls) < 4 else None}}

    assert [w["id"] for w in catalogue.works(fetch, "https://api.example.org/works", catalogue.build_filter("tea", 2001, 2003), sleep=lambda s: None)] == ["W2", "W3", "W4"]
    assert "publication_year%3A2001-2003" in calls[0]
    work = '{"id":"W1","doi":"https://doi.org/10.1/A","display_name":"T","publication_year":2001,"abstract_inverted_index":{"b":[1],"a":[0,2]},"concepts":[{"display_name":"x","level":1,"score":0.5},{"display_name":"y","level":0,"score":0.9}]}'
    row = catalogue.map_works(spark.createDataFrame([(work,)], "value string")).first()
    assert (row["abstract"], row["doi"], row["indexKeywords"]) == ("a b a", "10.1/a", ["x"])


def test_strategy(spark):
    s = strategy.concepts("Machine learning for diabetes in older adults")
    assert [b.terms[0] for b in s.blocks][:2] == ["machine learning", "diabetes"]
    assert strategy.compile_query(strategy.Strategy(s.blocks[:1], 2001, 2003), "index_b") == 'TS=("machine learning" OR "statistical learning" OR "aprendizaje automatico") AND PY=2001-2003'
    assert len(strategy.merge(s, 0, 1).blocks) == len(s.blocks) - 1
    assert strategy.language("Análisis de la educación") == "es"
    df = spark.createDataFrame([("Statistical learning of Diabetes in older adult patients", 2002), ("Machine learning", 2002)], "t string, y int")
    assert df.where(strategy.predicate(s, df.t, df.y)).count() == 1


def test_network_files(spark):
    nodes = spark.createDataFrame([("a&b", 1.5), ("c", 2.0)], "node string, degree double")
    edges = spark.createDataFrame([("a&b", "c", 0.123456789)], "src string, dst string, weight double")
    assert 'id="a&amp;b"' in writers.graphml(nodes, edges) and "0.12345679" in writers.gexf(nodes, edges)
    assert writers.pajek(nodes, edges).splitlines()[-1] == "1 2 0.12345679"
    assert writers.bundle({"t": nodes})[:2] == b"PK"


def test_project_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    writers.save_project(df, {"threshold": 0.9}, str(tmp_path / "p"))
    rows, settings = writers.load_project(spark, str(tmp_path / "p"))
    assert rows.collect() == df.collect() and settings == {"threshold": 0.9}


def test_warnings_and_repeated_files(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text(CSV)
    (tmp_path / "b" / "y.ris").write_text(RIS.replace("PY  - 2011\n", "") + RIS.replace("DO  - https://doi.org/10.1000/r.1\n", ""))
    path = f"{tmp_path}/*/*"
    assert [r["path"].split("/")[-2:] for r in reader.repeated_files(spark, path).collect()] == [["b", "x.csv"]]
    rows = reader.read_bib(spark, path, skip_repeated=True)
    assert sorted(r["file"] for r in rows.collect()) == ["x.csv", "y.ris", "y.ris"]
    found = {(r["file"], r["code"]): r["value"] for r in reader.import_warnings(rows).collect()}
    assert {c for f, c in found if f == "y.ris"} == {"noReferences", "noKeywords", "noAffiliations", "noCitations", "noYear"} and found["y.ris", "noYear"] == 1
    assert {c for f, c in found if f == "x.csv"} == {"noAbstract", "noKeywords", "noAffiliations", "fewDoi"}
