"""Analyses as compositions: co-citation, coupling, evolution of themes, bundles for export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import fold
from quillon.operators import citations, indicators, kernels, networks


def cited_units(refs: DataFrame, unit: str = "work", clusters: DataFrame | None = None) -> DataFrame:
    """(doc, item) of cited works (by cluster), first authors (surname and first initial) or sources (the group of the name)."""
    if unit == "work":
        return refs.join(clusters, "occ").select("doc", F.col("cluster").alias("item")).distinct()
    if unit == "author":
        initial = F.regexp_extract(F.col("first_author"), r"[\s,]+(\p{Lu})", 1)
        key = F.concat_ws(" ", citations.surname_of(F.col("first_author")), F.lower(initial))
        return refs.where(F.coalesce("first_author", F.lit("")) != "").select("doc", key.alias("item")).distinct()
    named = refs.where(F.coalesce("source", F.lit("")) != "")
    groups = citations.cited_source_groups(named.groupBy("source").agg(F.count("*").alias("n")))
    return named.join(groups, "source").select("doc", F.col("grp").alias("item")).distinct()


def coupling_units(docs: DataFrame, cited: DataFrame, unit: Column | None = None, local: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Incidence (doc = unit, item = cited work), and units with citations, local citations, documents and size."""
    own = docs.select("doc", (unit if unit is not None else F.col("doc")).alias("unit"), "cited").where("unit is not null")
    inc = cited.join(own.select("doc", "unit"), "doc").select(F.col("unit").alias("doc"), "item").distinct()
    n = local.groupBy(F.col("cited").alias("doc")).agg(F.count("*").alias("local")) if local is not None else own.select("doc", F.lit(0).alias("local"))
    table = own.join(n, "doc", "left").groupBy("unit").agg(F.sum("cited").alias("citations"), F.coalesce(F.sum("local"), F.lit(0)).alias("local"), F.count("*").alias("docs"))
    size = inc.groupBy(F.col("doc").alias("unit")).agg(F.count("*").alias("size"))
    return inc, table.join(size, "unit")


def select_units(units: DataFrame, n: int) -> DataFrame:
    """The first n units by citations (missing last), local citations, documents, key."""
    return units.orderBy(F.coalesce("citations", F.lit(-1)).desc(), F.desc("local"), F.desc("docs"), "unit").limit(n)


def coupling_network(inc: DataFrame, chosen: DataFrame, measure: str = "salton", min_edge: int = 1) -> DataFrame:
    """Edges between the chosen units; an end's frequency is the number of works it cites."""
    some = inc.join(chosen.select(F.col("unit").alias("doc")), "doc", "left_semi")
    return networks.network(networks.coupling(some), chosen.select(F.col("unit").alias("item"), F.col("size").alias("freq")), measure, min_edge)


def cluster_terms(rows: DataFrame, communities: DataFrame, n: int = 5) -> DataFrame:
    """rows(doc, term): per cluster the terms with the highest c*c/total in two documents or more (or any, if there is none)."""
    of = communities.select(F.col("node").alias("doc"), "community")
    total = rows.groupBy("term").agg(F.countDistinct("doc").alias("total"))
    c = rows.join(of, "doc").groupBy("community", "term").agg(F.countDistinct("doc").alias("c")).join(total, "term")
    w = Window.partitionBy("community")
    c = c.withColumn("best", F.max("c").over(w)).where("c > 1 or best < 2").withColumn("score", F.col("c") * F.col("c") / F.col("total"))
    rank = F.row_number().over(w.orderBy(F.desc("score"), "term"))
    return c.withColumn("rank", rank).where(F.col("rank") <= n).select("community", "term", "c", "score", "rank")


def periods(first: int, last: int, cuts: list[int]) -> list[tuple[int, int]]:
    """Spans that end at each cut; cuts outside [first, last) are ignored, four at most are used."""
    ends = sorted({c for c in cuts if first <= c < last})[:4] + [last]
    starts = [first] + [e + 1 for e in ends[:-1]]
    return list(zip(starts, ends, strict=True))


def thematic_evolution(rows: DataFrame, spans: list[tuple[int, int]], words: int = 250, min_freq: int = 2) -> tuple[DataFrame, DataFrame]:
    """rows(doc, item, year): themes (period, node, community) and links of consecutive periods.

    Periods are few and their networks bounded; all are clustered in one pass, a group each.
    """
    edges = None
    for k, (a, b) in enumerate(spans):
        inc, items = networks.incidence(rows.where(F.col("year").between(a, b)), min_freq, words)
        e = networks.network(networks.cooccurrence(inc), items).withColumn("period", F.lit(k))
        edges = e if edges is None else edges.unionByName(e)
    themes = kernels.communities(edges, by="period")
    links = None
    for k in range(len(spans) - 1):
        two = [themes.where(F.col("period") == p).select("node", "community") for p in (k, k + 1)]
        one = networks.theme_links(*two).withColumn("period", F.lit(k))
        links = one if links is None else links.unionByName(one)
    return themes, links


def network_analysis(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per node degree, strength, rank, betweenness, closeness, community; and one row of nodes, edges, density, transitivity."""
    nodes = networks.degrees(edges).join(networks.pagerank(edges), "node").join(kernels.betweenness(edges), "node").join(kernels.communities(edges), "node")
    size = nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))
    density = indicators.ratio(2 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1))
    return nodes, size.withColumn("density", density).crossJoin(F.broadcast(networks.transitivity(edges)))


def disambiguated(rows: DataFrame, label: str, key: str) -> DataFrame:
    """``label`` with (2), (3), ... where several rows have the same."""
    w = Window.partitionBy(label).orderBy(key)
    i = F.row_number().over(w)
    return rows.withColumn(label, F.when(i > 1, F.concat(F.col(label), F.lit(" ("), i.cast("string"), F.lit(")"))).otherwise(F.col(label)))


def document_label(author: Column, year: Column, source: Column) -> Column:
    return F.concat_ws(", ", F.nullif(author, F.lit("")), year.cast("string"), F.nullif(source, F.lit("")))


def reference_short(rows: DataFrame, limit: int = 90) -> DataFrame:
    """rows(first_author, year, source, volume, page, doi, label) with short: "Smith J, 2001, Nature", at most ``limit`` long.

    Works of equal author, year and source get volume and first page (or the DOI). With under two of the three the label serves.
    """
    parts = F.array_compact(F.array(F.nullif("first_author", F.lit("")), F.col("year").cast("string"), F.nullif("source", F.lit(""))))
    plain = F.when(F.size(parts) >= 2, F.array_join(parts, ", ")).otherwise(F.coalesce("label", F.lit("")))
    place = F.coalesce(F.nullif(F.concat_ws(":", F.nullif("volume", F.lit("")), F.nullif("page", F.lit(""))), F.lit("")), F.nullif("doi", F.lit("")))
    same = F.count("*").over(Window.partitionBy(plain))
    full = F.when((F.size(parts) >= 2) & (same > 1) & place.isNotNull(), F.concat(plain, F.lit(", "), place)).otherwise(plain)
    return rows.withColumn("short", full).withColumn("short", F.when(F.length("short") > limit, F.concat(F.rtrim(F.substring("short", 1, limit - 1)), F.lit("…"))).otherwise(F.col("short")))


def reference_analysis(docs: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Local citations, and clusters of cited works that take the matched documents into account."""
    matched = citations.local_citations(docs, refs)
    return matched, citations.reference_clusters(refs, citations.matched_references(docs, refs))


def run_all(collection, reference_year: int) -> dict[str, DataFrame]:
    """Every table of a collection by name, lazily: nothing runs until one is written."""
    d, a = collection.docs, collection.authors
    tables: dict[str, Callable[[], DataFrame]] = {
        "overview": lambda: indicators.overview(collection.docs_with_countries, a, collection.keywords, collection.references, reference_year),
        "annual": lambda: indicators.annual(d, reference_year), "document types": lambda: indicators.doc_types(d), "sources": lambda: indicators.sources_table(d, reference_year),
        "Bradford zones": lambda: indicators.bradford_zones(d.groupBy("source").agg(F.count("*").alias("n"))), "source dynamics": lambda: indicators.dynamics(d.select("source", "year"), "source"),
        "authors": lambda: indicators.authors_table(d, a, reference_year), "author production": lambda: indicators.author_production(d, a, reference_year), "Lotka": lambda: indicators.lotka_distribution(a),
        "cited documents": lambda: indicators.cited_documents(d, reference_year), "reference years": lambda: indicators.rpys(collection.references), "countries": lambda: indicators.countries_table(collection.docs_with_countries),
        "collaboration": lambda: networks.country_collaboration(collection.countries)[0], "timeline": lambda: indicators.collaboration_timeline(collection.docs_with_countries, a),
    }
    return {name: f() for name, f in tables.items()}
