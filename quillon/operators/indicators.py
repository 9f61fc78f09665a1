"""Production and impact indicators.

Inputs are long tables of a collection:
  docs     doc, year, source, doc_type, cited (null: not reported; 0 is a value), countries
  authors  doc, pos, author   one row per signature, order significant
A window is partitioned by the unit it ranks (source, author, ...) after an aggregation
to (unit, citations, n), so that its rows are bounded by the distinct citation counts of a
unit rather than by its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ordering import numbered, running_sums
from quillon.store import Stages


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0 or null."""
    return a.cast("double") / F.when(b != 0, b.cast("double"))


def year_spine(years: DataFrame, year: str = "year", pad: int = 0) -> DataFrame:
    """Every year from the first to the last one of ``years``, with ``pad`` more at both ends."""
    span = years.where(F.col(year).isNotNull()).agg(F.min(year).alias("a"), F.max(year).alias("b")).where("a is not null")
    return span.select(F.explode(F.sequence(F.col("a") - pad, F.col("b") + pad)).alias(year))


def _ladder(docs: DataFrame, unit: str, cited: str) -> DataFrame:
    """Per unit and citation count, from the top: documents so far and citations so far."""
    counts = docs.where(F.col(cited).isNotNull()).groupBy(unit, cited).agg(F.count("*").alias("n"))
    w = Window.partitionBy(unit).orderBy(F.desc(cited)).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(unit, F.col(cited).alias("c"), "n", F.sum("n").over(w).alias("rank"), F.sum(F.col("n") * F.col(cited)).over(w).alias("total"))


def h_index(docs: DataFrame, unit: str = "source", cited: str = "cited") -> DataFrame:
    """(unit, h): the most h documents with h citations or more; null without a reported count."""
    # inside a run of equal counts the rank rises one by one, so its best is min(c, last rank)
    steps = _ladder(docs, unit, cited).select(unit, F.least("c", "rank").alias("h"))
    return steps.groupBy(unit).agg(F.max("h").cast("long").alias("h"))


def g_index(docs: DataFrame, unit: str = "source", cited: str = "cited") -> DataFrame:
    """(unit, g): the largest g, up to the number of documents, whose top g have g*g citations or more."""
    steps = _ladder(docs, unit, cited)
    # within a run: before = total - n c at rank - n; largest k in the run with before + c (k - r0) >= k^2
    before, r0 = F.col("total") - F.col("n") * F.col("c"), F.col("rank") - F.col("n")
    c = F.col("c").cast("double")
    root = F.floor((c + F.sqrt(F.greatest(c * c + 4.0 * (before - c * r0), F.lit(0.0)))) / 2.0).cast("long")
    fits = lambda k: (k > r0) & (k <= F.col("rank")) & (before + F.col("c") * (k - r0) >= k * k)
    tries = F.array(*[F.least(root + d, F.col("rank")) for d in (1, 0, -1)])
    best = F.array_max(F.filter(tries, lambda k: fits(k)))
    return steps.select(unit, F.coalesce(best, F.lit(0)).alias("g")).groupBy(unit).agg(F.max("g").cast("long").alias("g"))


def m_index(h: Column, first_year: Column, reference_year: int) -> Column:
    """h per year since the first publication; null for a first year after the reference year."""
    years = F.lit(reference_year) - first_year + 1
    return F.when(years > 0, h.cast("double") / years)


def sources_table(docs: DataFrame, reference_year: int, unit: str = "source") -> DataFrame:
    """Per source: n, share, cumulative share, citations, h, g, m, first and last year, rank.

    h, g and m are null where no document reports citations. Rank: n desc, citations desc, label.
    """
    base = docs.where(F.col(unit).isNotNull()).groupBy(unit).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("cited"), F.lit(0)).cast("long").alias("citations"), F.count("cited").alias("cited_docs"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )
    full = base.join(h_index(docs, unit), unit, "left").join(g_index(docs, unit), unit, "left")
    # one row per unit: ranks and running sums by ranges of the order
    ranked = running_sums(full, [F.desc("n"), F.desc("citations"), F.col(unit)], {"n": "upto"}, Stages(docs.sparkSession, "sources"), "ranks", to="rank")
    total = ranked.agg(F.max("upto").alias("all_docs"))
    return ranked.crossJoin(F.broadcast(total)).select(
        unit, "n", (100.0 * ratio(F.col("n"), F.col("all_docs"))).alias("share"),
        (100.0 * ratio(F.col("upto"), F.col("all_docs"))).alias("cumulative"),
        "citations", "cited_docs", ratio(F.col("citations"), F.col("cited_docs")).alias("mean_cited"), "h", "g",
        m_index(F.col("h"), F.col("first_year"), reference_year).alias("m"), "first_year", "last_year",
        "rank",
    )


def bradford_zones(table: DataFrame, unit: str = "source") -> DataFrame:
    """(unit, n, rank, cumulative, zone): three zones of about a third of the documents each.

    A zone ends at the first rank whose running total is nearest to the target; the second
    cut is sought after the first.
    """
    stages = Stages(table.sparkSession, "bradford")
    ranked = running_sums(table.select(unit, "n"), [F.desc("n"), F.col(unit)], {"n": "cumulative"}, stages, "ranks", to="rank")
    ranked = stages.keep(ranked.select(unit, "n", "rank", "cumulative"), "ranked")  # read three times
    total = ranked.agg(F.max("cumulative").alias("t"))
    near = lambda k: F.struct(F.abs(F.col("cumulative") - F.col("t") * k / 3.0).alias("d"), F.col("rank").alias("r"))
    one = ranked.crossJoin(F.broadcast(total)).agg(F.min(near(1)).getField("r").alias("cut1"))
    both = ranked.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(one))
    two = both.where("rank > cut1").agg(F.min(near(2)).getField("r").alias("cut2"))
    zone = F.when(F.col("rank") <= F.col("cut1"), 1).when(F.col("rank") <= F.coalesce("cut2", "cut1"), 2).otherwise(3)
    return ranked.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(two)).select(unit, "n", "rank", "cumulative", zone.alias("zone"))


def annual(docs: DataFrame, reference_year: int) -> DataFrame:
    """Per year, gaps filled: n, running total, mean citations, and those per citable year."""
    counts = docs.groupBy("year").agg(F.count("*").alias("n"), F.avg("cited").alias("mean_cited"))
    w = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)  # one row a year
    full = year_spine(docs).join(counts, "year", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    citable = F.lit(reference_year) - F.col("year") + 1
    return full.select("year", "n", F.sum("n").over(w).alias("cumulative"), "mean_cited", F.when(citable > 0, F.col("mean_cited") / citable).alias("mean_cited_per_year"))


def growth_rate(first: Column, last: Column, years: Column) -> Column:
    """Compound annual growth in per cent; null for one year or nothing in the first one."""
    return F.when((years > 1) & (first > 0), (F.pow(last.cast("double") / first, 1.0 / (years - 1)) - 1) * 100)


def overview(docs: DataFrame, authors: DataFrame, keywords: DataFrame, references: DataFrame, reference_year: int) -> DataFrame:
    """One row of scalars: period, counts, citations, authorship, growth, age, international share.

    docs.countries is a list; a document with two or more distinct ones is international, out of all documents.
    """
    main = docs.agg(
        F.count("*").alias("documents"), F.count_if(F.col("year").isNull()).alias("no_year"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.countDistinct("source").alias("sources"), F.coalesce(F.sum("cited"), F.lit(0)).cast("long").alias("citations"), F.count("cited").alias("cited_docs"),
        F.avg("cited").alias("mean_cited"), F.avg(F.lit(reference_year) - F.col("year")).alias("mean_age"),
        F.count_if(F.size(F.array_distinct("countries")) > 1).alias("international"),
    )
    per_doc = authors.groupBy("doc").agg(F.count("*").alias("k"), F.min("author").alias("a"))
    sign = per_doc.agg(F.count("*").alias("docs_with_authors"), F.sum("k").alias("appearances"), F.count_if(F.col("k") == 1).alias("single_docs"))
    alone = per_doc.where("k = 1").agg(F.countDistinct("a").alias("single_authors"))
    ends = annual(docs, reference_year).agg(F.min_by("n", "year").alias("n0"), F.max_by("n", "year").alias("n1"), F.count("*").alias("years"))
    one = lambda df, c, name: df.agg(F.countDistinct(c).alias(name))
    wide = main
    for part in (sign, alone, ends, one(authors, "author", "authors"), one(keywords, "term", "keywords"), one(references, "ref", "references")):
        wide = wide.crossJoin(F.broadcast(part))  # single rows
    return wide.withColumns(
        {
            "authors_per_doc": ratio(F.col("appearances"), F.col("docs_with_authors")),
            "growth": growth_rate(F.col("n0"), F.col("n1"), F.col("years")),
            "international_share": 100.0 * ratio(F.col("international"), F.col("documents")),
        }
    ).drop("n0", "n1")


def doc_types(docs: DataFrame) -> DataFrame:
    """Per document type: n, share, citations, documents that report them, mean."""
    total = docs.agg(F.count("*").alias("t"))
    table = docs.groupBy("doc_type").agg(F.count("*").alias("n"), F.coalesce(F.sum("cited"), F.lit(0)).cast("long").alias("citations"), F.count("cited").alias("cited_docs"))
    return table.crossJoin(F.broadcast(total)).select(
        "doc_type", "n", (100.0 * ratio(F.col("n"), F.col("t"))).alias("share"), "citations", "cited_docs", ratio(F.col("citations"), F.col("cited_docs")).alias("mean_cited")
    )


def dynamics(rows: DataFrame, unit: str) -> DataFrame:
    """rows(unit, year): annual and running counts per unit on the dense years of all rows."""
    counts = rows.groupBy(unit, "year").agg(F.count("*").alias("n"))
    grid = rows.select(unit).distinct().crossJoin(F.broadcast(year_spine(rows)))
    w = Window.partitionBy(unit).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(counts, [unit, "year"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select(unit, "year", "n", F.sum("n").over(w).alias("cumulative"))


def ranked_authors(table: DataFrame) -> DataFrame:
    """``authors_table`` with ``rank``: documents desc, citations desc, author."""
    return numbered(table, [F.desc("n"), F.desc("citations"), F.col("author")], Stages(table.sparkSession, "authors"), "ranks", to="rank").withColumn("rank", F.col("rank") + 1)


def authors_table(docs: DataFrame, authors: DataFrame, reference_year: int) -> DataFrame:
    """Per author: documents, fractional count (1/k over the distinct authors of a document), citations, h, g, m."""
    signed = authors.select("doc", "author").where("author is not null").distinct()
    k = signed.groupBy("doc").agg(F.count("*").alias("k"))
    rows = signed.join(k, "doc").join(docs.select("doc", "year", "cited"), "doc")
    base = rows.groupBy("author").agg(
        F.count("*").alias("n"), F.sum(1.0 / F.col("k").cast("double")).alias("fractional"), F.coalesce(F.sum("cited"), F.lit(0)).cast("long").alias("citations"),
        F.count("cited").alias("cited_docs"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )
    return (
        base.join(h_index(rows, "author"), "author", "left").join(g_index(rows, "author"), "author", "left")
        .withColumn("m", m_index(F.col("h"), F.col("first_year"), reference_year))
    )


def author_production(docs: DataFrame, authors: DataFrame, reference_year: int) -> DataFrame:
    """Per author and year: documents, citations, citations per citable year."""
    rows = authors.select("doc", "author").distinct().join(docs.select("doc", "year", "cited"), "doc").where("year is not null")
    citable = F.lit(reference_year) - F.col("year") + 1
    return rows.groupBy("author", "year").agg(F.count("*").alias("n"), F.coalesce(F.sum("cited"), F.lit(0)).cast("long").alias("citations")).withColumn(
        "citations_per_year", F.when(citable > 0, F.col("citations") / citable)
    )


def lotka_distribution(authors: DataFrame) -> DataFrame:
    """(x, authors): how many authors have x documents."""
    per = authors.select("doc", "author").distinct().groupBy("author").agg(F.count("*").alias("x"))
    return per.groupBy("x").agg(F.count("*").alias("authors"))


def lotka_fit(authors: DataFrame) -> DataFrame:
    """beta, constant c and r2 of log10 share = log10 c - beta log10 x.

    The fit takes the gap-free run 1..r of x if it has three points or more, else all x. Null with under two points.
    """
    dist = lotka_distribution(authors)
    order = Window.orderBy("x")  # one row per distinct productivity
    total = dist.agg(F.sum("authors").cast("double").alias("t"))
    ranked = dist.withColumn("run", F.row_number().over(order) == F.col("x"))
    run = ranked.where("run").agg(F.count("*").alias("r"))
    points = ranked.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(run)).where("r < 3 or run").select(
        F.log10(F.col("x").cast("double")).alias("lx"), F.log10(F.col("authors") / F.col("t")).alias("ly")
    )
    fit = points.agg(F.count("*").alias("points"), F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("icept"), F.regr_r2("ly", "lx").alias("r2"))
    many = F.col("points") >= 2
    return fit.select(
        "points", F.when(many, -F.col("slope")).alias("beta"), F.when(many, F.pow(F.lit(10.0), F.col("icept"))).alias("c"), F.when(many, F.col("r2")).alias("r2")
    )


def lotka_ks(authors: DataFrame) -> DataFrame:
    """The largest gap of the running shares to those of 6 / pi^2 / x^2 over x = 1..max, and critical values."""
    dist = lotka_distribution(authors)
    totals = dist.agg(F.sum("authors").alias("t"), F.max("x").alias("top"))
    dense = totals.where("t is not null").select("t", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top"))).alias("x"))
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    rows = dense.join(dist, "x", "left").select(
        "x", "t", F.sum(F.coalesce("authors", F.lit(0)) / F.col("t")).over(w).alias("seen"), F.sum(6.0 / (F.lit(3.141592653589793) ** 2) / (F.col("x") * F.col("x"))).over(w).alias("theory")
    )
    return rows.groupBy("t").agg(F.max(F.abs(F.col("seen") - F.col("theory"))).alias("d")).select(
        F.col("t").alias("authors"), "d", (1.36 / F.sqrt("t")).alias("critical_5"), (1.63 / F.sqrt("t")).alias("critical_1")
    )


def ks_p_value(d: float, n: int) -> float:
    """Kolmogorov's tail probability with Stephens' correction for n."""
    import math

    lam = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if lam < 0.2:
        return 1.0
    total = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 201))
    return min(1.0, max(0.0, total))


def lotka_constant(beta: float, terms: int = 20) -> float | None:
    """1 / zeta(beta) by a truncated sum with the usual remainder terms; null for beta <= 1."""
    if beta <= 1:
        return None
    head = sum(x**-beta for x in range(1, terms))
    tail = 1 / ((beta - 1) * terms ** (beta - 1)) + 1 / (2 * terms**beta) + beta / (24 * (terms - 1) ** (beta + 1))
    return 1 / (head + tail)


def cited_documents(docs: DataFrame, reference_year: int) -> DataFrame:
    """Per document: citations per citable year, and relative to the mean of its year."""
    means = docs.where("year is not null and cited is not null").groupBy("year").agg(F.avg("cited").alias("year_mean"))
    citable = F.lit(reference_year) - F.col("year") + 1
    return docs.where("cited is not null").join(means, "year", "left").select(
        "doc", "year", "cited", F.when(citable > 0, F.col("cited") / citable).alias("per_year"),
        F.when(F.col("year_mean") > 0, F.col("cited") / F.col("year_mean")).when(F.col("year_mean") == 0, 0.0).alias("normalized"),
    )


def institutions_table(docs: DataFrame, places: DataFrame) -> DataFrame:
    """places(doc, author, institution): distinct documents, appearances (author x institution), share of all documents."""
    total = docs.agg(F.count("*").alias("t"))
    rows = places.where("institution is not null").groupBy("institution").agg(F.countDistinct("doc").alias("documents"), F.count("*").alias("appearances"))
    return rows.crossJoin(F.broadcast(total)).select("institution", "documents", "appearances", (100.0 * ratio(F.col("documents"), F.col("t"))).alias("share"))


def countries_table(docs: DataFrame) -> DataFrame:
    """docs(doc, country, countries, cited): single- and multiple-country publications per corresponding country."""
    multiple = F.size(F.array_distinct(F.concat(F.coalesce("countries", F.array()), F.array("country")))) > 1
    rows = docs.where("country is not null").groupBy("country").agg(
        F.count("*").alias("n"), F.count_if(~multiple).alias("scp"), F.count_if(multiple).alias("mcp"), F.avg("cited").alias("mean_cited")
    )
    return rows.withColumn("mcp_ratio", F.col("mcp") / F.col("n"))


def rpys(cited_works: DataFrame, half: int = 2) -> DataFrame:
    """cited_works(year), one row per citation: references per year, 5-year median, deviation, peaks.

    Absent years count 0, also those around the ends.
    """
    counts = cited_works.where("year is not null").groupBy("year").agg(F.count("*").alias("n"))
    dense = year_spine(cited_works, pad=half + 1).join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.orderBy("year")  # one row a year
    dev = dense.withColumn("median", F.percentile("n", F.lit(0.5)).over(w.rowsBetween(-half, half))).withColumn("deviation", F.col("n") - F.col("median"))
    before, after = F.lag("deviation").over(w), F.lead("deviation").over(w)
    marked = dev.withColumn("peak", (F.col("deviation") > 0) & (F.col("deviation") > F.coalesce(before, F.lit(0.0))) & (F.col("deviation") >= F.coalesce(after, F.lit(0.0))))
    ends = counts.agg(F.min("year").alias("a"), F.max("year").alias("b"))
    return marked.crossJoin(F.broadcast(ends)).where("year between a and b").select("year", "n", "median", "deviation", "peak")


def trend_topics(term_years: DataFrame, minimum: int = 5, per_year: int = 5) -> DataFrame:
    """term_years(term, year): quartiles of a term's years; the most frequent terms of each rounded median year."""
    q = F.percentile("year", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = term_years.where("year is not null").groupBy("term").agg(F.count("*").alias("n"), q.alias("q")).where(F.col("n") >= minimum)
    rows = rows.select("term", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), F.floor(F.col("q")[1] + 0.5).cast("long").alias("at_year"))
    w = Window.partitionBy("at_year").orderBy(F.desc("n"), "term")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= per_year)


def collaboration_timeline(docs: DataFrame, authors: DataFrame) -> DataFrame:
    """Per year, gaps filled: mean authors per document that has some, and the share with several countries."""
    k = authors.select("doc", "author").distinct().groupBy("doc").agg(F.count("*").alias("k"))
    rows = docs.where("year is not null").join(k, "doc", "left").groupBy("year").agg(
        F.count("*").alias("n"), F.avg("k").alias("mean_authors"),
        ratio(F.count_if(F.size(F.array_distinct("countries")) > 1), F.count_if(F.size("countries") > 0)).alias("international"),
    )
    return year_spine(docs).join(rows, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"), "mean_authors", "international")
