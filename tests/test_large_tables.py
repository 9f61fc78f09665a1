"""What larger tables showed: graphs without edges, files that do not fit a task, joins whose keys grow."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.text import fold, norm_title, title_probe
from quillon.operators import citations, networks
from quillon.sources import reader

EDGES = "src long, dst long, count long, weight double"


def test_pagerank_without_edges_has_no_rows(spark):
    assert networks.pagerank(spark.createDataFrame([], EDGES)).collect() == []


def test_transitivity_without_edges_or_triples_is_that_of_sql(spark):
    of = lambda rows: tuple(networks.transitivity(spark.createDataFrame(rows, EDGES)).first())
    assert of([]) == (0, None, None)
    single = of([(1, 2, 1, 1.0), (3, 4, 1, 1.0)])
    assert single[:2] == (0, 0) and math.isnan(single[2])
    assert of([(1, 2, 1, 1.0), (2, 3, 1, 1.0), (1, 3, 1, 1.0)]) == (1, 3, 1.0)


def test_large_tables_are_read_row_by_row_as_whole_ones_are(spark, tmp_path, monkeypatch):
    head = "Authors,Title,Year,Source title,Cited by,DOI,Affiliations,Authors with affiliations\n"
    row = lambda i: f'"Smith, J.; Roe, P.","A ""title"" {i},\n over two lines",200{i % 10},J Test,{i},10.1/x{i},"Univ A, Chile; Univ B, Spain","Smith, J., Univ A, Chile; Roe, P., Univ B, Spain"\n'
    files = {
        "a.csv": ("Export of today\n\n" + head + "".join(map(row, range(30))) + ",,2001,J Test\n" + "short\n" + ",only a title\n").encode(), "b one+two.csv": head.encode() + row(7).encode(), "latin.csv": (head + "Núñez A,Título,1999,Revista\n").encode("latin-1"),
        "wide.csv": ("﻿" + head.replace(",", ";") + "Núñez A;Título;1999;Revista;;;;;more;cells\n").encode("utf-16-le"), "tab.txt": "PT\tAU\tTI\tSO\tPY\nJ\tSmith, J\tA thing\tJ Test\t2001\n".encode(), "bom.csv": ("﻿" + head + row(3)).encode(), "head.csv": head.encode(), "no.csv": b"x\ny\n",
        "t.ris": b"TY  - JOUR\nTI  - One\nAU  - Smith, J\nPY  - 2001\nER  - \n", "u.bib": b"@article{a, title={One}, year=2001}\n",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = lambda: sorted(repr(r.asDict(True)) for r in reader.read_bib(spark, str(tmp_path)).collect())
    want = rows()
    monkeypatch.setattr(reader, "LARGE", 1)
    monkeypatch.setattr(reader, "CHUNK", 4)
    whole = reader._parse
    monkeypatch.setattr(reader, "_parse", lambda frames: whole(f[f["path"].str.contains("u.bib|no.csv")] for f in frames))  # no other file may come here
    assert rows() == want


REFS = "occ long, doc long, first_author string, year long, source string, volume string, page string, doi string, work_id string, raw string"
WORKS = "doc long, surname string, year long, source string, volume string, first_page string, doi string, work_id string, title string"


def _plain_matches(spark, docs, refs):
    """What the rules say, from all pairs of a year."""
    r = refs.withColumns({"s": citations.surname_of(F.col("first_author")), "text": norm_title(F.col("raw"))}).where("year is not null and s != ''").alias("r")
    d = docs.withColumns({"s": F.regexp_replace(fold(F.col("surname")), r"[^\p{L}]+", ""), "probe": title_probe(F.col("title"))}).alias("d")
    near = F.expr("substring(r.s, 1, 3) = substring(d.s, 1, 3) and length(r.s) >= 6 and length(d.s) >= 6 and levenshtein(r.s, d.s) = 1")
    pairs = r.join(d, F.expr("r.year = d.year") & (F.expr("r.s = d.s") | near))
    differ = lambda a, b: F.expr(f"coalesce({a}, '') != '' and coalesce({b}, '') != '' and {a} != {b}")
    same = lambda a, b: F.expr(f"coalesce({a}, '') != '' and coalesce({a}, '') = coalesce({b}, '')")
    source, titled = citations.sources_match(F.col("r.source"), F.col("d.source")), F.expr("d.probe != '' and contains(r.text, d.probe)")
    page, volume = same("r.page", "d.first_page"), same("r.volume", "d.volume")
    ok = titled | F.when(near, source & volume & ~differ("r.page", "d.first_page")).otherwise((source & ~differ("r.page", "d.first_page")) | (volume & page))
    good = pairs.where(~differ("r.volume", "d.volume") & ok).select("r.occ", "d.doc", (4 * titled.cast("int") + 2 * page.cast("int") + (~near).cast("int")).alias("rank"))
    by = {}
    for occ, doc, rank in good.collect():
        by.setdefault(occ, {}).setdefault(rank, set()).add(doc)
    best = {occ: x[max(x)] for occ, x in by.items()}
    return {(occ, min(x), "reference" if len(x) == 1 else "ambiguous") for occ, x in best.items()}


def test_matches_are_those_of_all_pairs_and_candidates_are_few(spark):
    rnd = random.Random(5)
    names = ["garcia", "garcias", "gartia", "gaarcia", "garciaa", "smith", "smyth", "aaaaaa", "aaaaa", "aaaaaaa", "aaaaba", ""]
    one = lambda: (rnd.choice(names), rnd.choice([1999, 2000, None]), rnd.choice(["J Test", "Journal of Testing", "", None]), rnd.choice(["1", "2", "", None]), rnd.choice(["5", "6", "", None]))
    works = [(i, *one(), "", "", rnd.choice(["", "", "The growth of networks in large tables"])) for i in range(150)]
    refs = [(i, 1000 + i, f"{n.upper()} A", y, s, v, p, "", "", rnd.choice(["x", "The growth of networks in large tables, 1999"])) for i in range(400) for n, y, s, v, p in [one()]]
    docs, cites = spark.createDataFrame(works, WORKS), spark.createDataFrame(refs, REFS)
    want = _plain_matches(spark, docs, cites)
    assert len({how for _, _, how in want}) == 2
    assert {(r["occ"], r["cited"], r["how"]) for r in citations.all_matches(docs, cites).collect()} == want
    # pages tell the works of one journal volume apart: few pairs, whatever the surnames
    n = 3000
    many = spark.range(n).select(F.col("id").alias("doc"), F.concat(F.lit("abcdef"), F.chr(97 + F.col("id") % 26)).alias("s"), F.lit(2000).cast("long").alias("year"), F.lit("J").alias("source"), F.lit("1").alias("volume"), F.col("id").cast("string").alias("first_page"), F.lit("").alias("doi"), F.lit("").alias("probe"))
    own = many.select(F.col("doc").alias("occ"), "doc", "s", "year", "source", "volume", F.col("first_page").alias("page"), "doi", F.lit("").alias("text"))
    assert citations._candidates(own, many).count() == n
