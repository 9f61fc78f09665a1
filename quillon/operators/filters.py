"""Filters, facets, table search and systematic-review views."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import contains_all, fold
from quillon.operators.ordering import numbered
from quillon.store import Stages


@dataclass(frozen=True)
class Filters:
    """An empty set or None lets everything pass. 'none' among the languages means no language."""

    year_from: int | None = None
    year_to: int | None = None
    doc_types: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    sources: tuple = ()
    areas: tuple[str, ...] = ()
    min_cited: int | None = None

    @property
    def active(self) -> bool:
        return self != Filters()

    def condition(self, columns: dict[str, str] | None = None) -> Column:
        name = {"year": "year", "doc_type": "doc_type", "languages": "languages", "source": "source", "areas": "areas", "cited": "cited"} | (columns or {})
        out = F.lit(True)
        if self.year_from is not None:
            out = out & F.coalesce(F.col(name["year"]) >= self.year_from, F.lit(False))
        if self.year_to is not None:
            out = out & F.coalesce(F.col(name["year"]) <= self.year_to, F.lit(False))
        if self.doc_types:
            out = out & F.col(name["doc_type"]).isin(*self.doc_types)
        if self.languages:
            own = F.coalesce(F.col(name["languages"]), F.array())
            hit = F.arrays_overlap(own, F.array(*map(F.lit, self.languages)))
            out = out & ((hit | (F.size(own) == 0)) if "none" in self.languages else hit)
        if self.sources:
            out = out & F.col(name["source"]).isin(*self.sources)
        if self.areas:
            out = out & F.arrays_overlap(F.transform(name["areas"], fold), F.array(*[fold(F.lit(a)) for a in self.areas]))
        if self.min_cited is not None:
            out = out & F.coalesce(F.col(name["cited"]) >= self.min_cited, F.lit(False))
        return out


def apply_filters(docs: DataFrame, filters: Filters, columns: dict[str, str] | None = None) -> DataFrame:
    """Rows that pass all filters; the table itself if none is set."""
    return docs.where(filters.condition(columns)) if filters.active else docs


def facets(docs: DataFrame, names: list[str]) -> DataFrame:
    """(facet, value, n) of scalar or list columns in one pass; a value counts once a document."""
    kinds = dict(docs.dtypes)
    one = lambda c: F.array_distinct(F.col(c).cast("array<string>")) if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))
    pairs = F.flatten(F.array(*[F.transform(one(c), _named(c)) for c in names]))
    return docs.select(F.explode(pairs).alias("p")).where("p.value is not null").groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def _named(name: str):
    return lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value"))


#: Letters compare without case and accents, in the order of the root locale.
COLLATION = "UNICODE_CI_AI"


def natural(c: Column) -> Column:
    """A sort key of text: letters by collation, runs of digits by their value, so that 10 comes after 9."""
    parts = F.regexp_extract_all(c, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    bare = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    numbered = lambda x: F.concat(F.lpad(F.length(bare(x)).cast("string"), 4, "0"), bare(x))  # noqa: E731  longer numbers are larger
    return F.collate(F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), numbered(x)).otherwise(x)), ""), COLLATION)


@dataclass
class TableView:
    """Search, sort and page of a table: text in natural order, blanks last in both directions, ties by ``position``."""

    search: str = ""
    sort: str | None = None
    descending: bool = False
    page: int = 0
    size: int = 25
    position: str = "doc"
    search_columns: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        out = df
        if self.search.strip():
            columns = self.search_columns or df.columns
            out = out.where(contains_all(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]), self.search))
        keys = []
        if self.sort:
            text = dict(df.dtypes)[self.sort] == "string"
            c = F.nullif(F.col(self.sort), F.lit("")) if text else F.col(self.sort)
            c = natural(c) if text else c
            keys.append(c.desc_nulls_last() if self.descending else c.asc_nulls_last())
        return out.orderBy(*keys, self.position).offset(self.page * self.size).limit(self.size)


def top(df: DataFrame, by: str, n: int, key: str) -> DataFrame:
    return df.orderBy(F.desc(by), key).limit(n)


def included(docs: DataFrame, decisions: DataFrame, key: str = "key") -> DataFrame:
    """Records whose decision is include."""
    return docs.join(decisions.where("decision = 'include'").select(key), key, "left_semi")


def screening_view(docs: DataFrame, decisions: DataFrame, view: str = "all", key: str = "key") -> DataFrame:
    """docs with decision; pending means no decision or maybe."""
    rows = docs.join(decisions.select(key, "decision"), key, "left")
    if view == "all":
        return rows
    if view == "pending":
        return rows.where("decision is null or decision = 'maybe'")
    return rows.where(F.col("decision") == view)


def one_decision(decisions: DataFrame, key: str = "key") -> DataFrame:
    """(key, decision, reason): of a key decided twice the first in order of both, so that every run agrees."""
    reason = F.col("reason") if "reason" in decisions.columns else F.lit(None).cast("string")
    rows = decisions.where("decision is not null").select(key, F.struct("decision", reason.alias("reason")).alias("d"))
    return rows.groupBy(key).agg(F.min("d").alias("d")).select(key, "d.decision", "d.reason")


def decision_table(docs: DataFrame, decisions: DataFrame, key: str = "key", order: str | None = None) -> DataFrame:
    """The rows of a decision export: ``n`` from 1 in ``order`` (default: key), all columns of ``docs``, decision, stage, reason.

    A document without a decision has empty texts. Stage and reason are of excluded ones: fulltext with a reason, else
    screening. Numbers are counted by ranges, so that the table may be of any size.
    """
    rows = docs.join(one_decision(decisions, key), key, "left")
    out = F.coalesce(F.col("decision") == "exclude", F.lit(False))
    reason = F.when(out, F.coalesce("reason", F.lit(""))).otherwise("")
    rows = rows.withColumn("stage", F.when(~out, "").when(reason != "", "fulltext").otherwise("screening")).withColumns({"reason": reason, "decision": F.coalesce("decision", F.lit(""))})
    found = numbered(rows, [order or key], Stages(docs.sparkSession, "decisions"), "rows", to="n")
    return found.select((F.col("n") + 1).alias("n"), *docs.columns, "decision", "stage", "reason")


NOT_RETRIEVED = "notRetrieved"


def prisma_numbers(documents: DataFrame, decisions: DataFrame, databases: Column, registers: int = 0, duplicates: int = 0, automation: int = 0, filtered: int = 0, other: int = 0, key: str = "key") -> DataFrame:
    """One row with every number of the flow diagram. ``databases`` may use the column documents (keys to screen).

    Exclusions without a reason count at screening, with the reason notRetrieved at retrieval, with another at
    assessment. balanced: what was assessed and not excluded is included or pending, and all screened have a key.
    """
    rows = documents.select(key).distinct().join(one_decision(decisions, key), key, "left")
    is_ = lambda *values: F.coalesce(F.col("decision").isin(*values), F.lit(False))
    out, reason = is_("exclude"), F.coalesce("reason", F.lit(""))
    counted = rows.agg(
        F.count("*").alias("documents"), F.count_if(is_("include")).alias("included"), F.count_if(is_("maybe")).alias("maybe"), F.count_if(out & (reason == "")).alias("excluded"),
        F.count_if(out & (reason == NOT_RETRIEVED)).alias("not_retrieved"), F.count_if(out & ~reason.isin("", NOT_RETRIEVED)).alias("reports_excluded"),
        F.count_if(~is_("include", "maybe", "exclude")).alias("undecided"),
    )
    removed = max(0, duplicates) + max(0, automation) + max(0, filtered) + max(0, other)
    steps = counted.withColumn("identified", databases.cast("long") + max(0, registers)).withColumn("removed", F.lit(removed).cast("long"))
    least = lambda c: F.greatest(F.lit(0).cast("long"), c)
    steps = steps.withColumn("screened", least(F.col("identified") - F.col("removed"))).withColumn("sought", least(F.col("screened") - F.col("excluded")))
    steps = steps.withColumn("assessed", least(F.col("sought") - F.col("not_retrieved"))).withColumn("pending", F.col("maybe") + F.col("undecided"))
    return steps.withColumn("decided", F.col("documents") - F.col("undecided")).withColumn(
        "balanced", (F.col("assessed") - F.col("reports_excluded") == F.col("included") + F.col("pending")) & (F.col("screened") == F.col("documents"))
    )


def prisma_flow(identified: DataFrame, decisions: DataFrame, removed_duplicates: int = 0, removed_other: int = 0, key: str = "key") -> DataFrame:
    """One row of counts: identified, removed, screened, included, excluded, maybe, pending, balanced."""
    keys = identified.select(key).distinct()
    rows = keys.join(one_decision(decisions, key), key, "left")
    total = identified.agg(F.count("*").alias("identified"))
    counted = rows.agg(
        F.count("*").alias("unique"), F.count_if(F.col("decision") == "include").alias("included"), F.count_if(F.col("decision") == "exclude").alias("excluded"),
        F.count_if(F.col("decision") == "maybe").alias("maybe"), F.count_if(F.col("decision").isNull()).alias("undecided"),
    )
    removed = removed_duplicates + removed_other
    return total.crossJoin(F.broadcast(counted)).select(
        "identified", F.lit(removed).cast("long").alias("removed"), F.greatest(F.lit(0), F.col("identified") - removed).alias("screened"),
        "included", "excluded", "maybe", "undecided", (F.greatest(F.lit(0), F.col("identified") - removed) == F.col("unique")).alias("balanced"),
    )


def exclusion_reasons(decisions: DataFrame) -> DataFrame:
    """(reason, n) of excluded records; no reason is 'unspecified'."""
    return decisions.where("decision = 'exclude'").groupBy(F.coalesce("reason", F.lit("unspecified")).alias("reason")).agg(F.count("*").alias("n"))
