"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

Doubles are rounded to 6 places on both sides, since sums depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import dedup, entities, filters, indicators, kernels, networks, terms
from quillon.operators.components import connected_components
from quillon.plans.views import REFERENCE_YEAR as REF
from quillon.plans.views import Collection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DOCS = f"""docs AS (SELECT o_orderkey AS doc, CAST(year(o_orderdate) AS BIGINT) AS year, o_custkey AS source, o_orderstatus AS doc_type,
  o_orderpriority AS language, CAST(floor(o_totalprice / 50000) AS BIGINT) AS cited, {REF} AS ref FROM orders)"""
H = """(SELECT {u}, max(least(cited, rk)) AS h FROM (SELECT {u}, cited, row_number() OVER (PARTITION BY {u} ORDER BY cited DESC) AS rk FROM {t}) GROUP BY {u})"""
G = """(SELECT {u}, coalesce(max(rk) FILTER (tot >= rk * rk), 0) AS g FROM (SELECT {u}, row_number() OVER (PARTITION BY {u} ORDER BY cited DESC) AS rk,
  sum(cited) OVER (PARTITION BY {u} ORDER BY cited DESC ROWS UNBOUNDED PRECEDING) AS tot FROM {t}) GROUP BY {u})"""
SPINE = "spine AS (SELECT CAST(unnest(range((SELECT min(year) FROM docs), (SELECT max(year) FROM docs) + 1)) AS BIGINT) AS year)"
SIGNED = "signed AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS author FROM lineitem)"
INC = """f AS (SELECT l_partkey AS item, count(DISTINCT l_orderkey) AS freq FROM lineitem GROUP BY 1 ORDER BY freq DESC, item LIMIT 300),
inc AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS item FROM lineitem JOIN f ON l_partkey = item),
co AS (SELECT a.item AS src, b.item AS dst, count(*) AS c FROM inc a JOIN inc b ON a.doc = b.doc AND a.item < b.item GROUP BY 1, 2)"""
FOLDED = "strip_accents(lower({}))"


def query(name: str, sql: str | None = None):
    """Registers a function of a Collection."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Collection(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


@query("source_h_index", f"WITH {DOCS} SELECT source, CAST(h AS BIGINT) AS h FROM {H.format(u='source', t='docs')}")
def source_h_index(c):
    return indicators.h_index(c.docs)


@query("source_g_index", f"WITH {DOCS} SELECT source, CAST(g AS BIGINT) AS g FROM {G.format(u='source', t='docs')}")
def source_g_index(c):
    return indicators.g_index(c.docs)


@query(
    "source_table_hgm",
    f"""WITH {DOCS}, b AS (SELECT source, count(*) AS n, CAST(sum(cited) AS BIGINT) AS citations, count(cited) AS cited_docs, min(year) AS first_year, max(year) AS last_year FROM docs GROUP BY 1)
SELECT source, n, round(100.0 * n / sum(n) OVER (), 6) AS share, round(100.0 * sum(n) OVER w / sum(n) OVER (), 6) AS cumulative, citations, cited_docs,
  round(citations / cited_docs, 6) AS mean_cited, CAST(h AS BIGINT) AS h, CAST(g AS BIGINT) AS g, round(h / ({REF} - first_year + 1), 6) AS m, first_year, last_year, row_number() OVER w AS rank
FROM b JOIN {H.format(u='source', t='docs')} USING (source) JOIN {G.format(u='source', t='docs')} USING (source)
WINDOW w AS (ORDER BY n DESC, citations DESC, source ROWS UNBOUNDED PRECEDING)""",
)
def source_table(c):
    return rounded(indicators.sources_table(c.docs, REF))


@query(
    "bradford_zones",
    f"""WITH {DOCS}, r AS (SELECT source, count(*) AS n FROM docs GROUP BY 1),
k AS (SELECT source, n, row_number() OVER w AS rank, CAST(sum(n) OVER w AS BIGINT) AS cumulative, sum(n) OVER () AS t FROM r WINDOW w AS (ORDER BY n DESC, source ROWS UNBOUNDED PRECEDING)),
c1 AS (SELECT rank AS cut FROM k ORDER BY abs(cumulative - t / 3.0), rank LIMIT 1), c2 AS (SELECT rank AS cut FROM k WHERE rank > (FROM c1) ORDER BY abs(cumulative - t * 2 / 3.0), rank LIMIT 1)
SELECT source, n, rank, cumulative, CAST(CASE WHEN rank <= (FROM c1) THEN 1 WHEN rank <= (FROM c2) THEN 2 ELSE 3 END AS BIGINT) AS zone FROM k""",
)
def bradford(c):
    return rounded(indicators.bradford_zones(c.docs.groupBy("source").agg(F.count("*").alias("n"))))


@query(
    "overview_scalars",
    f"""WITH {DOCS}, nat AS (SELECT l_orderkey AS doc, count(DISTINCT s_nationkey) AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
pd AS (SELECT l_orderkey AS doc, count(*) AS k, min(l_suppkey) AS a FROM lineitem GROUP BY 1), y AS (SELECT year, count(*) AS n FROM docs GROUP BY 1)
SELECT count(*) AS documents, CAST(count(*) FILTER (year IS NULL) AS BIGINT) AS no_year, min(year) AS first_year, max(year) AS last_year, count(DISTINCT source) AS sources,
  CAST(sum(cited) AS BIGINT) AS citations, count(cited) AS cited_docs, round(avg(cited), 6) AS mean_cited, round(avg({REF} - year), 6) AS mean_age,
  (SELECT count(*) FROM nat JOIN docs USING (doc) WHERE k > 1) AS international, (SELECT count(*) FROM pd) AS docs_with_authors, (SELECT CAST(sum(k) AS BIGINT) FROM pd) AS appearances,
  (SELECT count(*) FROM pd WHERE k = 1) AS single_docs, (SELECT count(DISTINCT a) FROM pd WHERE k = 1) AS single_authors, max(year) - min(year) + 1 AS years,
  (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS authors, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS keywords, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS references,
  round((SELECT sum(k) / count(*) FROM pd), 6) AS authors_per_doc,
  round((pow((SELECT arg_max(n, year) FROM y)::DOUBLE / (SELECT arg_min(n, year) FROM y), 1.0 / (max(year) - min(year))) - 1) * 100, 6) AS growth,
  round(100.0 * (SELECT count(*) FROM nat JOIN docs USING (doc) WHERE k > 1) / count(*), 6) AS international_share FROM docs""",
)
def overview(c):
    return rounded(indicators.overview(c.docs_with_countries, c.authors, c.keywords, c.references, REF))


@query(
    "annual_production",
    f"""WITH {DOCS}, {SPINE}, y AS (SELECT year, count(*) AS n, avg(cited) AS mc FROM docs GROUP BY 1)
SELECT year, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (ORDER BY year) AS BIGINT) AS cumulative, round(mc, 6) AS mean_cited, round(mc / ({REF} - year + 1), 6) AS mean_cited_per_year FROM spine LEFT JOIN y USING (year)""",
)
def annual(c):
    return rounded(indicators.annual(c.docs, REF))


@query(
    "doc_types",
    f"""WITH {DOCS} SELECT doc_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share, CAST(sum(cited) AS BIGINT) AS citations, count(cited) AS cited_docs, round(sum(cited) / count(cited), 6) AS mean_cited FROM docs GROUP BY 1""",
)
def doc_types(c):
    return rounded(indicators.doc_types(c.docs))


@query(
    "source_dynamics",
    f"""WITH {DOCS}, {SPINE}, k AS (SELECT source, year, count(*) AS n FROM docs GROUP BY 1, 2)
SELECT s.source, spine.year, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY s.source ORDER BY spine.year) AS BIGINT) AS cumulative
FROM (SELECT DISTINCT source FROM docs) s CROSS JOIN spine LEFT JOIN k ON k.source = s.source AND k.year = spine.year""",
)
def source_dynamics(c):
    return indicators.dynamics(c.docs.select("source", "year"), "source")


@query(
    "authors_full_fractional",
    f"""WITH {DOCS}, {SIGNED}, k AS (SELECT doc, count(*) AS k FROM signed GROUP BY 1), r AS (SELECT author, year, cited, k FROM signed JOIN k USING (doc) JOIN docs USING (doc))
SELECT author, count(*) AS n, round(sum(1.0::DOUBLE / k), 6) AS fractional, CAST(sum(cited) AS BIGINT) AS citations, count(cited) AS cited_docs, min(year) AS first_year, max(year) AS last_year,
  CAST(any_value(h) AS BIGINT) AS h, CAST(any_value(g) AS BIGINT) AS g, round(any_value(h) / ({REF} - min(year) + 1), 6) AS m
FROM r JOIN {H.format(u='author', t='r')} USING (author) JOIN {G.format(u='author', t='r')} USING (author) GROUP BY author""",
)
def authors_table(c):
    return rounded(indicators.authors_table(c.docs, c.authors, REF))


@query(
    "author_production",
    f"""WITH {DOCS}, {SIGNED} SELECT author, year, count(*) AS n, CAST(sum(cited) AS BIGINT) AS citations, round(sum(cited) / ({REF} - year + 1), 6) AS citations_per_year FROM signed JOIN docs USING (doc) GROUP BY author, year""",
)
def author_production(c):
    return rounded(indicators.author_production(c.docs, c.authors, REF))


LOTKA = "p AS (SELECT o_custkey AS author, count(*) AS x FROM orders GROUP BY 1), d AS (SELECT x, count(*) AS authors FROM p GROUP BY 1)"


@query(
    "lotka_fit",
    f"""WITH {LOTKA}, k AS (SELECT x, authors, row_number() OVER (ORDER BY x) = x AS run, sum(authors) OVER () AS t FROM d),
pts AS (SELECT log10(x) AS lx, log10(authors / t) AS ly FROM k WHERE run OR (SELECT count(*) FROM k WHERE run) < 3)
SELECT count(*) AS points, round(-regr_slope(ly, lx), 6) AS beta, round(pow(10, regr_intercept(ly, lx)), 6) AS c, round(regr_r2(ly, lx), 6) AS r2 FROM pts""",
)
def lotka_fit(c):
    return rounded(indicators.lotka_fit(c.docs.select("doc", F.col("source").alias("author"))))


@query(
    "lotka_ks",
    f"""WITH {LOTKA}, t AS (SELECT sum(authors) AS t, max(x) AS top FROM d), s AS (SELECT unnest(range(1, (SELECT top FROM t) + 1)) AS x),
c AS (SELECT sum(coalesce(authors, 0) / (SELECT t FROM t)) OVER w AS seen, sum(6.0::DOUBLE / pow(pi(), 2) / (s.x * s.x)) OVER w AS theory FROM s LEFT JOIN d USING (x) WINDOW w AS (ORDER BY s.x))
SELECT CAST(t AS BIGINT) AS authors, round((SELECT max(abs(seen - theory)) FROM c), 6) AS d, round(1.36 / sqrt(t), 6) AS critical_5, round(1.63 / sqrt(t), 6) AS critical_1 FROM t""",
)
def lotka_ks(c):
    return rounded(indicators.lotka_ks(c.docs.select("doc", F.col("source").alias("author"))))


@query(
    "cited_documents_normalised",
    f"""WITH {DOCS} SELECT doc, year, cited, round(cited / ({REF} - year + 1), 6) AS per_year, round(CASE WHEN m = 0 THEN 0 ELSE cited / m END, 6) AS normalized FROM (SELECT *, avg(cited) OVER (PARTITION BY year) AS m FROM docs)""",
)
def cited_documents(c):
    return rounded(indicators.cited_documents(c.docs, REF))


@query(
    "institutions",
    """SELECT l_partkey AS institution, count(DISTINCT l_orderkey) AS documents, count(*) AS appearances, round(100.0 * count(DISTINCT l_orderkey) / (SELECT count(*) FROM orders), 6) AS share FROM lineitem GROUP BY 1""",
)
def institutions(c):
    return rounded(indicators.institutions_table(c.docs, c.keywords.select("doc", F.col("term").alias("institution"))))


@query(
    "countries_scp_mcp",
    f"""WITH {DOCS}, n AS (SELECT doc, c_nationkey AS country, cited FROM docs JOIN customer ON source = c_custkey),
a AS (SELECT l_orderkey AS doc, s_nationkey AS country FROM lineitem JOIN supplier ON l_suppkey = s_suppkey UNION SELECT doc, country FROM n), k AS (SELECT doc, count(DISTINCT country) AS k FROM a GROUP BY 1)
SELECT country, count(*) AS n, CAST(count(*) FILTER (k = 1) AS BIGINT) AS scp, CAST(count(*) FILTER (k > 1) AS BIGINT) AS mcp, round(avg(cited), 6) AS mean_cited, round(count(*) FILTER (k > 1) / count(*), 6) AS mcp_ratio FROM n JOIN k USING (doc) GROUP BY country""".replace("SELECT country,", "SELECT CAST(country AS BIGINT) AS country,"),
)
def countries(c):
    d = c.docs_with_countries.withColumns({"country": F.col("country").cast("bigint"), "countries": F.col("countries").cast("array<bigint>")})
    return rounded(indicators.countries_table(d))


@query(
    "rpys_spectroscopy",
    """WITH k AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS year, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT min(year) AS a, max(year) AS b FROM k),
s AS (SELECT unnest(range((SELECT a FROM e) - 3, (SELECT b FROM e) + 4)) AS year), f AS (SELECT s.year, coalesce(n, 0) AS n FROM s LEFT JOIN k USING (year)),
m AS (SELECT year, n, quantile_cont(n, 0.5) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS median FROM f), d AS (SELECT *, n - median AS deviation FROM m),
p AS (SELECT *, deviation > 0 AND deviation > coalesce(lag(deviation) OVER (ORDER BY year), 0) AND deviation >= coalesce(lead(deviation) OVER (ORDER BY year), 0) AS peak FROM d)
SELECT year, n, CAST(median AS DOUBLE) AS median, CAST(deviation AS DOUBLE) AS deviation, peak FROM p, e WHERE year BETWEEN a AND b""",
)
def rpys(c):
    return rounded(indicators.rpys(c.references))


@query(
    "trend_topics",
    """WITH q AS (SELECT l_partkey AS term, count(*) AS n, quantile_cont(year(o_orderdate), 0.25) AS q1, quantile_cont(year(o_orderdate), 0.5) AS median, quantile_cont(year(o_orderdate), 0.75) AS q3
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) >= 5)
SELECT term, n, CAST(q1 AS DOUBLE) AS q1, CAST(median AS DOUBLE) AS median, CAST(q3 AS DOUBLE) AS q3, CAST(floor(median + 0.5) AS BIGINT) AS at_year, row_number() OVER (PARTITION BY floor(median + 0.5) ORDER BY n DESC, term) AS rank FROM q QUALIFY rank <= 5""",
)
def trend_topics(c):
    return rounded(indicators.trend_topics(c.keywords.join(c.docs.select("doc", "year"), "doc").select("term", "year")))


@query(
    "year_quantiles",
    """SELECT l_suppkey AS supplier, round(quantile_cont(l_partkey, 0.25), 6) AS q1, round(quantile_cont(l_partkey, 0.5), 6) AS median, round(quantile_cont(l_partkey, 0.75), 6) AS q3 FROM lineitem GROUP BY 1""",
)
def year_quantiles(c):
    q = F.percentile("term", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = c.table("lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("term")).groupBy("supplier").agg(q.alias("q"))
    return rounded(rows.select("supplier", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")))


@query(
    "term_growth",
    f"""WITH {DOCS}, {SPINE}, t AS (SELECT l_partkey AS term, year FROM lineitem JOIN docs ON l_orderkey = doc), k AS (SELECT term, year, count(*) AS n FROM t GROUP BY 1, 2), u AS (SELECT DISTINCT term FROM t)
SELECT u.term, spine.year, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY u.term ORDER BY spine.year) AS BIGINT) AS cumulative FROM u CROSS JOIN spine LEFT JOIN k ON k.term = u.term AND k.year = spine.year""",
)
def term_growth(c):
    return indicators.dynamics(c.keywords.join(c.docs.select("doc", "year"), "doc").select("term", "year"), "term")


@query(
    "collaboration_timeline",
    f"""WITH {DOCS}, {SPINE}, {SIGNED}, k AS (SELECT doc, count(*) AS k FROM signed GROUP BY 1), n AS (SELECT l_orderkey AS doc, count(DISTINCT s_nationkey) AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
y AS (SELECT year, count(*) AS n, avg(k) AS a, (count(*) FILTER (c > 1))::DOUBLE / count(c) AS i FROM docs LEFT JOIN k USING (doc) LEFT JOIN n USING (doc) GROUP BY 1)
SELECT year, coalesce(n, 0) AS n, round(a, 6) AS mean_authors, round(i, 6) AS international FROM spine LEFT JOIN y USING (year)""",
)
def collaboration_timeline(c):
    return rounded(indicators.collaboration_timeline(c.docs_with_countries, c.authors))


# text -----------------------------------------------------------------------------------


@query("term_fold", f"SELECT doc_id AS doc, md5({FOLDED.format('text')}) AS folded FROM documents")
def term_fold(c):
    return c.texts.select("doc", F.md5(tx.fold(F.col("text")).cast("binary")).alias("folded"))


TOKENS = f"tk AS (SELECT doc_id AS doc, list_filter(regexp_extract_all({FOLDED.format('text')}, '[\\p{{L}}\\p{{N}}]+(?:-[\\p{{L}}\\p{{N}}]+)*'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9-]+$')) AS w FROM documents)"


@query("term_tokens", f"WITH {TOKENS} SELECT doc, CAST(len(w) AS BIGINT) AS n, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM tk")
def term_tokens(c):
    return c.texts.select("doc", tx.tokens(F.col("text")).alias("w")).select("doc", F.size("w").cast("bigint").alias("n"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in terms.STOP_WORDS) + "]"


@query(
    "stopword_bigrams",
    f"""WITH {TOKENS}, p AS (SELECT doc, w, unnest(range(1, len(w))) AS i FROM tk), b AS (SELECT doc, w[i] AS a, w[i + 1] AS b FROM p)
SELECT a || ' ' || b AS term, count(*) AS n, count(DISTINCT doc) AS docs FROM b WHERE NOT list_contains({_STOPS}, a) AND NOT list_contains({_STOPS}, b) GROUP BY 1 HAVING count(*) >= 20""",
)
def stopword_bigrams(c):
    return terms.long_bigrams(c.texts).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("docs")).where("n >= 20")


@query(
    "term_counts",
    """WITH t AS (SELECT event_id AS doc, lower(event_type) AS term, event_type AS label FROM events), d AS (SELECT DISTINCT doc, term, label FROM t), v AS (SELECT term, label, count(*) AS k FROM d GROUP BY 1, 2)
SELECT term, count(DISTINCT doc) AS n, (SELECT label FROM v WHERE v.term = d.term ORDER BY k DESC, label LIMIT 1) AS label FROM d GROUP BY term""",
)
def term_counts(c):
    return terms.term_counts(terms.clean_terms(c.table("events").select(F.col("event_id").alias("doc"), F.col("event_type").alias("term"))))


@query("title_edit_distance", "SELECT p_partkey AS part, CAST(levenshtein(p_name, 'analysis of networks') AS BIGINT) AS d FROM part")
def title_edit_distance(c):
    return c.table("part").select(F.col("p_partkey").alias("part"), F.levenshtein("p_name", F.lit("analysis of networks")).cast("bigint").alias("d"))


@query(
    "norm_title_words",
    "SELECT page_id AS page, md5(trim(regexp_replace(strip_accents(lower(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'))), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS title FROM pages",
)
def norm_title_words(c):
    return c.table("pages").select(F.col("page_id").alias("page"), F.md5(tx.norm_title(F.coalesce("html", F.lit(""))).cast("binary")).alias("title"))


# filters --------------------------------------------------------------------------------


@query(
    "filter_facets",
    f"""WITH {DOCS}, a AS (SELECT 'doc_type' AS facet, doc_type AS value FROM docs UNION ALL SELECT 'language', language FROM docs UNION ALL SELECT 'year', CAST(year AS VARCHAR) FROM docs) SELECT facet, value, count(*) AS n FROM a WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def filter_facets(c):
    return filters.facets(c.docs, ["doc_type", "language", "year"])


@query(
    "filtered_orders",
    f"WITH {DOCS} SELECT doc, year, source, doc_type, language, cited FROM docs WHERE year BETWEEN 1996 AND 1999 AND doc_type IN ('O', 'F') AND cited >= 2 AND language IN ('1-URGENT', '2-HIGH')",
)
def filtered_orders(c):
    own = c.docs.withColumn("languages", F.array("language"))
    some = filters.Filters(year_from=1996, year_to=1999, doc_types=("O", "F"), languages=("1-URGENT", "2-HIGH"), min_cited=2)
    return filters.apply_filters(own, some).drop("languages")


@query(
    "table_search_page",
    "SELECT c_custkey AS customer, c_name AS name, c_mktsegment AS segment FROM customer WHERE contains(lower(c_mktsegment || ' ' || c_name), 'auto') AND contains(lower(c_mktsegment || ' ' || c_name), '1') ORDER BY lower(c_name) DESC, c_custkey OFFSET 25 LIMIT 25",
)
def table_search_page(c):
    rows = c.table("customer").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return filters.TableView(search="AUTO 1", sort="name", descending=True, page=1, position="customer", search_columns=["segment", "name"]).apply(rows)


_STEMS = ["Étude", "etude", "Zoo", "ábaco", "ABACO"]


@query(
    "table_natural_sort",
    f"""SELECT p_partkey AS part, {_STEMS}[p_partkey % 5 + 1] || ' ' || (p_partkey % 1000) AS label FROM part
ORDER BY [2, 2, 3, 1, 1][p_partkey % 5 + 1] DESC, p_partkey % 1000 DESC, p_partkey OFFSET 75 LIMIT 25""",
)
def table_natural_sort(c):
    stem = F.get(F.array(*map(F.lit, _STEMS)), (F.col("p_partkey") % 5).cast("int"))
    rows = c.table("part").select(F.col("p_partkey").alias("part"), F.concat_ws(" ", stem, (F.col("p_partkey") % 1000).cast("string")).alias("label"))
    return filters.TableView(sort="label", descending=True, page=3, position="part").apply(rows)


@query(
    "authors_ranked",
    f"""WITH {DOCS}, {SIGNED}, r AS (SELECT author, count(*) AS n, CAST(sum(cited) AS BIGINT) AS citations FROM signed JOIN docs USING (doc) GROUP BY 1)
SELECT author, n, citations, row_number() OVER (ORDER BY n DESC, citations DESC, author) AS rank FROM r""",
)
def authors_ranked(c):
    return indicators.ranked_authors(indicators.authors_table(c.docs, c.authors, REF)).select("author", "n", "citations", "rank")


DECISIONS = "dec AS (SELECT doc_id AS key, CASE WHEN toxic = 1 THEN 'exclude' WHEN quality = 1 THEN 'include' ELSE 'maybe' END AS decision FROM labels)"


def _decisions(c):
    return c.table("labels").select(F.col("doc_id").alias("key"), F.when(F.col("toxic") == 1, "exclude").when(F.col("quality") == 1, "include").otherwise("maybe").alias("decision"))


@query(
    "decision_rows",
    f"""WITH {DECISIONS} SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id AS key, source, coalesce(decision, '') AS decision,
  CASE WHEN decision = 'exclude' THEN CASE WHEN doc_id % 2 = 0 THEN 'fulltext' ELSE 'screening' END ELSE '' END AS stage, CASE WHEN decision = 'exclude' AND doc_id % 2 = 0 THEN 'topic' ELSE '' END AS reason
FROM documents LEFT JOIN dec ON key = doc_id""",
)
def decision_rows(c):
    docs = c.table("documents").select(F.col("doc_id").alias("key"), "source")
    return filters.decision_table(docs, _decisions(c).withColumn("reason", F.when(F.col("key") % 2 == 0, "topic")))


@query(
    "prisma_flow",
    f"""WITH {DECISIONS}, r AS (SELECT doc_id AS key, decision FROM documents LEFT JOIN dec ON key = doc_id)
SELECT count(*) AS identified, CAST(7 AS BIGINT) AS removed, count(*) - 7 AS screened, CAST(count(*) FILTER (decision = 'include') AS BIGINT) AS included, CAST(count(*) FILTER (decision = 'exclude') AS BIGINT) AS excluded,
  CAST(count(*) FILTER (decision = 'maybe') AS BIGINT) AS maybe, CAST(count(*) FILTER (decision IS NULL) AS BIGINT) AS undecided, count(*) - 7 = count(DISTINCT key) AS balanced FROM r""",
)
def prisma_flow(c):
    return filters.prisma_flow(c.texts.select(F.col("doc").alias("key")), _decisions(c), removed_duplicates=7)


@query(
    "prisma_numbers",
    """WITH d AS (SELECT doc_id AS key, min(CASE WHEN toxic = 1 THEN 'exclude' WHEN quality = 1 THEN 'include' ELSE 'maybe' END) AS decision, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'notRetrieved' ELSE 'topic' END AS reason FROM labels GROUP BY 1, 3),
x AS (SELECT count(*) AS documents, count(*) FILTER (decision = 'include') AS included, count(*) FILTER (decision = 'maybe') AS maybe, count(*) FILTER (decision = 'exclude' AND reason IS NULL) AS excluded,
  count(*) FILTER (decision = 'exclude' AND reason = 'notRetrieved') AS not_retrieved, count(*) FILTER (decision = 'exclude' AND reason = 'topic') AS reports_excluded, count(*) FILTER (decision IS NULL) AS undecided
  FROM (SELECT DISTINCT doc_id AS key FROM documents) LEFT JOIN d USING (key))
SELECT *, documents + 7 AS identified, CAST(7 AS BIGINT) AS removed, documents AS screened, documents - excluded AS sought, documents - excluded - not_retrieved AS assessed, maybe + undecided AS pending,
  documents - undecided AS decided, documents - excluded - not_retrieved - reports_excluded = included + maybe + undecided AS balanced FROM x""",
)
def prisma_numbers(c):
    reason = F.when(F.col("key") % 3 == 1, filters.NOT_RETRIEVED).when(F.col("key") % 3 == 2, "topic")
    return filters.prisma_numbers(c.texts.select(F.col("doc").alias("key")), _decisions(c).withColumn("reason", reason), F.col("documents") + 7, duplicates=7)


@query("prisma_included", f"WITH {DECISIONS} SELECT doc_id AS key, lang FROM documents WHERE doc_id IN (SELECT key FROM dec WHERE decision = 'include')")
def prisma_included(c):
    return filters.included(c.texts.select(F.col("doc").alias("key"), "lang"), _decisions(c))


@query("prisma_pending", f"WITH {DECISIONS} SELECT doc_id AS key, decision FROM documents LEFT JOIN dec ON key = doc_id WHERE decision IS NULL OR decision = 'maybe'")
def prisma_pending(c):
    return filters.screening_view(c.texts.select(F.col("doc").alias("key")), _decisions(c), "pending")


# networks -------------------------------------------------------------------------------


def _parts(c, n=300):
    return networks.incidence(c.keywords.select("doc", F.col("term").alias("item")), max_items=n)


def _part_network(c, measure="association", n=300, min_edge=1):
    inc, items = _parts(c, n)
    return networks.network(networks.cooccurrence(inc), items, measure, min_edge)


@query(
    "cooccurrence_pairs",
    "WITH i AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS item FROM lineitem) SELECT a.item AS src, b.item AS dst, count(*) AS count FROM i a JOIN i b ON a.doc = b.doc AND a.item < b.item GROUP BY 1, 2",
)
def cooccurrence_pairs(c):
    return networks.cooccurrence(networks.incidence(c.keywords, item="term")[0])


@query(
    "coupling_pairs_salton",
    """WITH i AS (SELECT DISTINCT o_custkey AS doc, l_partkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey), s AS (SELECT doc, count(*) AS n FROM i GROUP BY 1),
k AS (SELECT a.doc AS src, b.doc AS dst, count(*) AS c FROM i a JOIN i b ON a.item = b.item AND a.doc < b.doc GROUP BY 1, 2) SELECT src, dst, c AS count, round(c / sqrt(x.n * y.n), 6) AS weight FROM k JOIN s x ON x.doc = src JOIN s y ON y.doc = dst""",
)
def coupling_pairs(c):
    rows = c.keywords.join(c.docs.select("doc", "source"), "doc").select(F.col("source").alias("doc"), F.col("term").alias("item"))
    inc, _ = networks.incidence(rows)
    sized = inc.join(inc.groupBy("doc").agg(F.count("*").alias("freq")), "doc")
    return rounded(networks.network(networks.coupling(sized, size="freq"), measure="salton"))


_WEIGHTS = {
    "none": "c::DOUBLE", "association": "c / (x.freq * y.freq)::DOUBLE", "salton": "c / sqrt(x.freq * y.freq)", "jaccard": "c / (x.freq + y.freq - c)::DOUBLE",
    "inclusion": "c / least(x.freq, y.freq)::DOUBLE", "equivalence": "c * c / (x.freq * y.freq)::DOUBLE",
}
for _m, _w in _WEIGHTS.items():
    ORACLE[f"cooc_{_m}"] = f"WITH {INC} SELECT src, dst, c AS count, round({_w}, 6) AS weight FROM co JOIN f x ON x.item = src JOIN f y ON y.item = dst"
    QUERIES[f"cooc_{_m}"] = (lambda m: lambda spark, d: rounded(_part_network(Collection(spark, d), m)))(_m)


@query(
    "network_degree_strength",
    f"WITH {INC}, e AS (SELECT src, dst, c FROM co UNION ALL SELECT dst, src, c FROM co) SELECT src AS node, count(*) AS degree, round(sum(c)::DOUBLE, 6) AS strength FROM e GROUP BY 1",
)
def network_degree_strength(c):
    return rounded(networks.degrees(_part_network(c, "none")))


@query(
    "modularity_fixed_partition",
    f"""WITH {INC}, p AS (SELECT p_partkey AS node, p_brand AS community FROM part), e AS (SELECT src, dst, c FROM co UNION ALL SELECT dst, src, c FROM co), m AS (SELECT sum(c) AS m2 FROM e),
k AS (SELECT community, sum(c) AS k FROM e JOIN p ON node = src GROUP BY 1), i AS (SELECT x.community, sum(c) AS w FROM e JOIN p x ON x.node = src JOIN p y ON y.node = dst AND x.community = y.community GROUP BY 1)
SELECT round(sum(coalesce(w, 0) / m2 - pow(k / m2, 2)), 6) AS q FROM k LEFT JOIN i USING (community), m""",
)
def modularity_fixed(c):
    return rounded(networks.modularity(_part_network(c, "none"), c.table("part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))))


@query(
    "transitivity",
    f"""WITH {INC}, e AS (SELECT src, dst FROM co UNION ALL SELECT dst, src FROM co), d AS (SELECT src, count(*) AS k FROM e GROUP BY 1),
t AS (SELECT count(*) AS triangles FROM co a JOIN co b ON a.dst = b.src JOIN co c ON c.src = a.src AND c.dst = b.dst), s AS (SELECT CAST(sum(k * (k - 1) / 2) AS BIGINT) AS triples FROM d)
SELECT triangles, triples, round(3.0::DOUBLE * triangles / triples, 6) AS transitivity FROM t, s""",
)
def transitivity(c):
    return rounded(networks.transitivity(_part_network(c, "none")))


@query(
    "country_collaboration",
    """WITH i AS (SELECT DISTINCT l_orderkey AS doc, CAST(s_nationkey AS BIGINT) AS country FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), k AS (SELECT doc, count(*) AS k FROM i GROUP BY 1),
p AS (SELECT a.country, b.country AS other, count(*) AS c FROM i a JOIN i b ON a.doc = b.doc AND a.country <> b.country GROUP BY 1, 2), q AS (SELECT country, count(*) AS partners, CAST(sum(c) AS BIGINT) AS collaborations FROM p GROUP BY 1)
SELECT country, count(*) AS documents, CAST(count(*) FILTER (k > 1) AS BIGINT) AS international, coalesce(any_value(partners), 0) AS partners, coalesce(any_value(collaborations), 0) AS collaborations FROM i JOIN k USING (doc) LEFT JOIN q USING (country) GROUP BY country""",
)
def country_collaboration(c):
    return rounded(networks.country_collaboration(c.countries.withColumn("country", F.col("country").cast("bigint")))[0])


@query("network_components")
def network_components(c):
    """All lines; SQL (a recursive query) is too slow for that, so a test holds it against brute force."""
    return connected_components(c.table("lineitem").select((F.col("l_suppkey") * 1000000).alias("src"), F.col("l_partkey").alias("dst")))


@query("pagerank")
def pagerank(c):
    return rounded(networks.pagerank(_part_network(c, "none", 100)))


@query("louvain")
def louvain(c):
    return kernels.communities(_part_network(c, n=100))


@query("fast_greedy")
def fast_greedy(c):
    return kernels.communities(_part_network(c, n=60), "fast_greedy")


@query("betweenness")
def betweenness(c):
    return rounded(kernels.betweenness(_part_network(c, n=100, min_edge=2)))


@query("thematic_map")
def thematic_map(c):
    net = _part_network(c, n=100)
    return rounded(networks.thematic_map(net, kernels.communities(net)))


@query(
    "theme_documents",
    f"""WITH {INC}, n AS (SELECT doc, p_size AS community, count(*) AS n FROM inc JOIN part ON p_partkey = item GROUP BY 1, 2) SELECT doc, CAST(community AS BIGINT) AS community, n FROM n QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, community) = 1""",
)
def theme_documents(c):
    own = c.table("part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("bigint").alias("community"))
    return networks.theme_documents(_parts(c)[0], own)


@query(
    "theme_links",
    """WITH x AS (SELECT p_partkey AS node, p_brand AS a, p_size AS b FROM part), sa AS (SELECT a, count(*) AS n FROM x GROUP BY 1), sb AS (SELECT b, count(*) AS n FROM x GROUP BY 1)
SELECT a, CAST(b AS BIGINT) AS b, count(*) AS shared, round(count(*) / least(any_value(sa.n), any_value(sb.n))::DOUBLE, 6) AS inclusion FROM x JOIN sa USING (a) JOIN sb USING (b) GROUP BY a, b""",
)
def theme_links(c):
    p = c.table("part")
    of = lambda col: p.select(F.col("p_partkey").alias("node"), F.col(col).alias("community"))
    return rounded(networks.theme_links(of("p_brand"), of("p_size")))


# cleaning -------------------------------------------------------------------------------

ITEMS = "it AS (SELECT doc_id AS rec, trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS title, lang AS year FROM documents)"


def _items(c, title=None):
    title = tx.norm_title(F.col("text") if title is None else title)
    return c.texts.select(F.col("doc").alias("rec"), F.lit("").alias("doi"), title.alias("title"), F.lit(None).cast("int").alias("year"), F.lit("").alias("surname"), F.col("source").alias("file"))


@query(
    "dedup_exact_title",
    f"""WITH {ITEMS}, k AS (SELECT title, min(rec) AS src FROM it WHERE length(title) >= 10 GROUP BY 1) SELECT src, rec AS dst FROM it JOIN k USING (title) WHERE rec <> src""",
)
def dedup_exact_title(c):
    return dedup.title_links(_items(c)).select("src", "dst")


@query("dedup_groups")
def dedup_groups(c):
    """Part names are titles, sizes years, brands files; a test holds the rules against brute force."""
    p = c.table("part")
    items = p.select(
        F.col("p_partkey").alias("rec"), F.lit("").alias("doi"), tx.norm_title(F.col("p_name")).alias("title"), F.col("p_size").cast("int").alias("year"), F.lit("").alias("surname"), F.col("p_brand").alias("file")
    )
    return rounded(dedup.duplicate_groups(items)[1])


@query(
    "merge_survivors",
    f"""WITH {ITEMS}, d AS (SELECT doc_id AS rec, text, source, n_chars, title, min(doc_id) OVER (PARTITION BY title) AS g, count(*) OVER (PARTITION BY title) AS merged FROM documents JOIN it ON rec = doc_id WHERE length(title) >= 10)
SELECT g AS "group", arg_max(rec, (n_chars, -rec)) AS base, max(merged) AS merged, md5(arg_max(text, (length(text), n_chars, -rec))) AS text, max(n_chars) AS n_chars FROM d WHERE merged > 1 GROUP BY g""",
)
def merge_survivors(c):
    items = _items(c)
    named = items.where(F.length("title") >= 10).select("rec", F.xxhash64("title").alias("t1"), F.xxhash64(F.lit(1), "title").alias("t2"))
    star = named.groupBy("t1", "t2").agg(F.min("rec").alias("group"), F.count("*").alias("k")).where("k > 1")
    members = named.join(star, ["t1", "t2"]).select("group", "rec")
    records = c.table("documents").select(F.col("doc_id").alias("rec"), "text", "n_chars")
    out = dedup.survivors(records, members, F.col("n_chars"), ["text"], [], [], ["n_chars"])
    return out.withColumn("text", F.md5(F.col("text").cast("binary")))


@query(
    "source_vote",
    "WITH k AS (SELECT o_custkey AS source, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1, 2) SELECT source, label FROM k QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, label) = 1",
)
def source_vote(c):
    return entities.vote(c.docs.select("source", F.col("language").alias("label")), "source", "label")


@query("source_groups")
def source_groups(c):
    p = c.table("part")
    return entities.source_groups(p.select(F.col("p_brand").alias("name"), (F.col("p_size") % 97).cast("string").alias("issn")))


@query(
    "author_variants",
    """WITH r AS (SELECT DISTINCT l_orderkey AS doc, 'n' || (l_suppkey % 20) || '|' || substr('abcd', CAST(l_suppkey % 2 + 1 AS BIGINT), 1) || (l_suppkey % 3) AS key FROM lineitem),
k AS (SELECT key, split_part(key, '|', 1) || '|' || substr(split_part(key, '|', 2), 1, 1) AS family, count(*) AS n FROM r GROUP BY 1), m AS (SELECT family, arg_max(key, (n, key)) AS main, count(*) AS c FROM k GROUP BY 1 HAVING count(*) > 1),
j AS (SELECT k.*, main FROM k JOIN m USING (family)), mates AS (SELECT DISTINCT j.family, main, j.key, o.key AS mate FROM j JOIN r x ON x.key = j.key JOIN r o ON o.doc = x.doc AND o.key <> j.key),
s AS (SELECT a.family, a.key, count(*) AS shared FROM mates a JOIN mates b ON b.family = a.family AND b.key = b.main AND b.mate = a.mate WHERE a.key <> a.main GROUP BY 1, 2)
SELECT family, key, n, coalesce(shared, 0) AS shared FROM j LEFT JOIN s USING (family, key)""",
)
def author_variants(c):
    k = F.concat(F.lit("n"), F.col("author") % 20, F.lit("|"), F.substring(F.lit("abcd"), (F.col("author") % 2 + 1).cast("int"), F.lit(1)), F.col("author") % 3)
    return entities.author_variants(c.authors.select("doc", k.alias("key")))


# multivariate ---------------------------------------------------------------------------


@query(
    "correspondence_cross",
    f"""WITH {INC}, k AS (SELECT doc, 1.0::DOUBLE / count(*) AS w FROM inc GROUP BY 1)
SELECT a.item AS src, b.item AS dst, round(sum(w), 6) AS weight FROM inc a JOIN inc b ON a.doc = b.doc AND a.item <= b.item JOIN k ON k.doc = a.doc GROUP BY 1, 2""",
)
def correspondence_cross(c):
    from quillon.operators import factorial

    return rounded(factorial.cross_table(_parts(c)[0]))


@query("correspondence_documents")
def correspondence_documents(c):
    from quillon.operators import factorial

    return rounded(factorial.correspondence_binary(_parts(c)[0])[2])


@query("factorial_mca")
def factorial_mca(c):
    from quillon.operators import factorial

    inc, items = _parts(c, 30)
    return rounded(factorial.factorial_words(inc, items, c.docs, clusters=4))


@query("factorial_clusters")
def factorial_clusters(c):
    from quillon.operators import factorial

    inc, items = _parts(c, 30)
    return factorial.word_clusters(inc, items, c.docs)
