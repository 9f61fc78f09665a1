"""The way from export files to tables computes what a table needs, and equal names once."""

from pyspark.sql import functions as F

from quillon.operators import cleaning
from quillon.sources import people, reader
from quillon.sources.reader import read_bib

HEAD = "Authors,Title,Year,Source title,DOI,Affiliations,Authors with affiliations\n"


def _folder(tmp_path, n=40):
    place = lambda i: f"Univ {'AB'[i % 2]}, City, {('Chile', 'Spain')[i % 2]}"
    row = lambda i: f'"Doe, J.; Roe, {"PQ"[i % 2]}.;","Study {i} of the salt plants",2001,J Salt,10.1234/a{i},"{place(i)}","Doe, J., {place(i)}; Roe, {"PQ"[i % 2]}., {place(i)}"\n'
    (tmp_path / "x.csv").write_text(HEAD + "".join(map(row, range(n))))
    return str(tmp_path / "x.csv")


def test_counts_and_countries_name_neither_institutions_nor_sources(spark, tmp_path, monkeypatch):
    def asked(*_):
        raise AssertionError("not needed")

    monkeypatch.setattr(cleaning, "institutions_of", asked)
    monkeypatch.setattr(cleaning, "source_groups", asked)
    own = cleaning.clean(read_bib(spark, _folder(tmp_path)))
    assert own.stats().first()["unique"] == 40
    assert {(r["country"], r["documents"]) for r in cleaning.countries_tables(own)[0].collect()} == {("chile", 20), ("spain", 20)}


def test_equal_signatures_are_named_once_in_both_joins(spark, tmp_path, monkeypatch):
    own = cleaning.clean(read_bib(spark, _folder(tmp_path)))
    assert own.forms.count() == 4  # of 80 signatures
    want = sorted(map(tuple, own.signatures.collect()))
    assert len(want) == 80 and {(r[2], r[3], tuple(r[5])) for r in want} == {("doe|j", "Doe J", ("University A",)), ("doe|j", "Doe J", ("University B",)), ("roe|p", "Roe P", ("University A",)), ("roe|q", "Roe Q", ("University B",))}
    monkeypatch.setattr(cleaning, "FORMS", 1)  # beyond it the join is a shuffle
    again = cleaning.with_forms(own.unique.select(F.col("rec").alias("doc"), F.posexplode("authors").alias("pos", "a")), own.forms)
    assert sorted(map(tuple, again.select("doc", "pos", "key", "label", "a.country", "institutions").collect())) == want
    full = own.records.select(F.col("rec").alias("doc"), F.posexplode("authors").alias("pos", "a")).select("doc", "pos", "a.key", "a.label", "a.country", "a.institutions")
    assert sorted(map(tuple, full.collect())) == want


def test_remembered_names_share_nothing():
    people._person.cache_clear()
    first = people.person("Doe, J.")
    first["affiliations"].append("x")
    assert people.person("Doe, J.")["affiliations"] == [] and people._person.cache_info().hits == 1


def test_head_of_a_large_file_is_its_first_lines(spark, tmp_path, monkeypatch):
    path = _folder(tmp_path, 200)
    size = len(open(path, "rb").read())
    monkeypatch.setattr(reader, "_HEAD", 300)
    head = reader._head(spark, f"file:{path}", size)
    assert head.endswith(b"\n") and len(head) <= 300 and open(path, "rb").read().startswith(head)
