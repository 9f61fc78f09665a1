"""Open-catalogue works over a paged API: a Python data source for batches and streams.

``spark.dataSource.register(WorksSource)``, then ``spark.read.format("works").option("base", url).load()``. Years are
partitions, each paged by a task of its own; conditions on year, type, language and open access go into the request
(``pushFilters``; on with ``spark.sql.python.filterPushdown.enabled``), all others are left to Spark. A stream goes from
page to page, with the service's cursor as its offset. ``map_works`` makes records of the rows.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader,
)

from quillon.functions.text import uniq

PAGE = 200
LIMIT = 5000
TRIES = 5
FIELDS = "id doi display_name publication_year type language cited_by_count authorships primary_location biblio referenced_works keywords topics concepts mesh funders awards abstract_inverted_index open_access".split()


def build_filter(terms: str = "", year_from: int | None = None, year_to: int | None = None, types: tuple[str, ...] = (), langs: tuple[str, ...] = (), open_access: bool | None = None) -> str:
    parts = []
    if terms:
        parts.append("title_and_abstract.search:" + terms)
    if year_from or year_to:
        parts.append(f"publication_year:{year_from or ''}-{year_to or ''}")
    if types:
        parts.append("type:" + "|".join(types))
    if langs:
        parts.append("language:" + "|".join(langs))
    if open_access is not None:
        parts.append(f"is_oa:{str(open_access).lower()}")
    return ",".join(parts)


def build_url(base: str, condition: str, cursor: str = "*", size: int = PAGE) -> str:
    return base + "?" + urllib.parse.urlencode({"filter": condition, "per-page": size, "cursor": cursor, "select": ",".join(FIELDS)})


class Busy(Exception):
    """The service asks to come back later (429 or 5xx)."""


def with_retry(fetch: Callable[[str], dict], url: str, sleep: Callable[[float], None] = time.sleep) -> dict:
    for k in range(TRIES):
        try:
            return fetch(url)
        except (Busy, ConnectionError, TimeoutError):
            if k == TRIES - 1:
                raise
            sleep(min(30, 2**k))
    raise AssertionError


def works(fetch: Callable[[str], dict], base: str, condition: str, limit: int = LIMIT, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Works page by page; a page that fails for good is asked for again in smaller pages."""
    cursor, size, n = "*", PAGE, 0
    while cursor and n < limit:
        try:
            page = with_retry(fetch, build_url(base, condition, cursor, size), sleep)
        except Busy:
            if size <= 25:
                raise
            size //= 2
            continue
        rows = page.get("results", [])
        if not rows:
            return
        for w in rows[: limit - n]:
            yield w
        n += len(rows)
        cursor = page.get("meta", {}).get("next_cursor")


def fetch_json(url: str) -> dict:
    """The JSON behind a URL; a busy service is asked again by ``with_retry``."""
    try:
        with urllib.request.urlopen(url, timeout=60) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        if e.code == 429 or e.code >= 500:
            raise Busy(str(e.code)) from e
        raise


class _Year(InputPartition):
    def __init__(self, first: int | None, last: int | None):
        self.first, self.last = first, last


class _Request:
    """What is asked for: options and pushed conditions."""

    def __init__(self, options: dict[str, str]):
        self.base, self.terms, self.limit = options["base"], options.get("search", ""), int(options.get("limit", LIMIT))
        self.first, self.last = (int(options[x]) if x in options else None for x in ("yearFrom", "yearTo"))
        self.types: list[str] = []
        self.langs: list[str] = []
        self.open_access: bool | None = None
        self.fetcher = options.get("fetch", "")

    def fetch(self) -> Callable[[str], dict]:
        """The function of option ``fetch`` (module:name), or the plain one."""
        if not self.fetcher:
            return fetch_json
        module, _, name = self.fetcher.partition(":")
        return getattr(importlib.import_module(module), name)

    def condition(self, first: int | None, last: int | None) -> str:
        return build_filter(self.terms, first, last, tuple(self.types), tuple(self.langs), self.open_access)

    def push(self, f) -> bool:
        """Takes a condition over if the service has it."""
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
        if column == "publication_year" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            low = f.value + isinstance(f, GreaterThan) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else None
            high = f.value - isinstance(f, LessThan) if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else None
            self.first = low if self.first is None else self.first if low is None else max(self.first, low)
            self.last = high if self.last is None else self.last if high is None else min(self.last, high)
            return True
        values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else []
        if column in ("type", "language") and values and all(isinstance(v, str) and not set(v) & set(",|:") for v in values):
            held = self.types if column == "type" else self.langs
            if not held:  # a second condition on the column is left to Spark
                held += values
                return True
        if column == "is_oa" and isinstance(f, EqualTo) and self.open_access is None:
            self.open_access = bool(f.value)
            return True
        return False


def _row(work: dict) -> tuple:
    return (work.get("id"), work.get("publication_year"), work.get("type"), work.get("language"), (work.get("open_access") or {}).get("is_oa"), json.dumps(work, ensure_ascii=False))


class WorksReader(DataSourceReader):
    """One partition a year if both ends are known, else one for all years; ``limit`` works a partition at most."""

    def __init__(self, request: _Request):
        self.request = request

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            if not self.request.push(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        first, last = self.request.first, self.request.last
        return [_Year(first, last)] if first is None or last is None else [_Year(y, y) for y in range(first, last + 1)]

    def read(self, partition: _Year) -> Iterator[tuple]:
        for work in works(self.request.fetch(), self.request.base, self.request.condition(partition.first, partition.last), self.request.limit):
            yield _row(work)


class WorksStream(SimpleDataSourceStreamReader):
    """A page a step; the offset is the service's cursor, so that a stream that starts again goes on where it was."""

    def __init__(self, request: _Request):
        self.request = request

    def initialOffset(self) -> dict:
        return {"cursor": "*"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if not start["cursor"]:
            return iter(()), start
        page = self._page(start["cursor"])
        following = page.get("meta", {}).get("next_cursor") if page.get("results") else None
        return iter([_row(w) for w in page.get("results", [])]), {"cursor": following or ""}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        cursor = start["cursor"]
        while cursor and cursor != end["cursor"]:
            page = self._page(cursor)
            yield from map(_row, page.get("results", []))
            cursor = page.get("meta", {}).get("next_cursor") if page.get("results") else ""

    def commit(self, end: dict) -> None:
        """Nothing is held for a page."""

    def _page(self, cursor: str) -> dict:
        r = self.request
        return with_retry(r.fetch(), build_url(r.base, r.condition(r.first, r.last), cursor))


class WorksSource(DataSource):
    """Options: base (the service's URL), search, yearFrom, yearTo, limit, fetch (module:function, url to JSON)."""

    @classmethod
    def name(cls) -> str:
        return "works"

    def schema(self) -> str:
        return "id string, publication_year int, type string, language string, is_oa boolean, value string"

    def reader(self, schema) -> WorksReader:
        return WorksReader(_Request(self.options))

    def simpleStreamReader(self, schema) -> WorksStream:
        return WorksStream(_Request(self.options))


def abstract_of(inverted: Column) -> Column:
    """{word: [places]} to a text."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.sort_array(pairs), lambda x: x["w"]), " ")


WORK = (
    "id string, doi string, display_name string, publication_year int, type string, language string, cited_by_count int, abstract_inverted_index map<string,array<int>>, referenced_works array<string>,"
    " authorships array<struct<author: struct<id: string, display_name: string, orcid: string>, countries: array<string>, institutions: array<struct<display_name: string, country_code: string>>>>,"
    " primary_location struct<source: struct<display_name: string, issn: array<string>, host_organization_name: string>>, biblio struct<volume: string, issue: string, first_page: string, last_page: string>,"
    " concepts array<struct<display_name: string, level: int, score: double>>, open_access struct<is_oa: boolean>, keywords array<struct<display_name: string>>, mesh array<struct<descriptor_name: string>>,"
    " topics array<struct<display_name: string, subfield: struct<display_name: string>, field: struct<display_name: string>>>, funders array<struct<id: string, display_name: string>>,"
    " awards array<struct<funder_id: string, funder_display_name: string, funder_award_id: string>>"
)


def map_works(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON texts of works to record columns.

    Index keywords are the keywords, topics, concepts of level 1 or more and score 0.3 or more, and subject headings; areas
    are the topics' subfields and fields; funding names each award, and each funder without one.
    """
    w = raw.select(F.from_json(column, WORK).alias("w"))
    c = lambda path: F.col(f"w.{path}")
    some = lambda path: F.coalesce(c(path), F.array())
    names = lambda a, field="display_name": F.filter(F.transform(a, lambda x: x[field]), lambda x: F.coalesce(x, F.lit("")) != "")
    strong = F.filter(some("concepts"), lambda x: (x["level"] >= 1) & (x["score"] >= 0.3))
    words = F.concat(names(some("keywords")), names(some("topics")), names(strong), names(some("mesh"), "descriptor_name"))
    areas = F.flatten(F.transform(some("topics"), lambda t: F.array_compact(F.array(t["subfield"]["display_name"], t["field"]["display_name"]))))
    awards = F.filter(some("awards"), lambda a: F.coalesce(a["funder_display_name"], F.lit("")) != "")
    named = F.transform(awards, lambda a: F.concat(a["funder_display_name"], F.when(F.coalesce(a["funder_award_id"], F.lit("")) != "", F.concat(F.lit(" ("), a["funder_award_id"], F.lit(")"))).otherwise("")))
    others = F.filter(some("funders"), lambda f: (F.coalesce(f["display_name"], F.lit("")) != "") & ~F.exists(awards, lambda a: a["funder_id"].eqNullSafe(f["id"])))
    funding = F.array_join(uniq(F.concat(named, names(others))), "; ")
    return w.select(
        c("id").alias("originId"), F.regexp_replace(F.lower(F.coalesce(c("doi"), F.lit(""))), "^https?://(?:dx\\.)?doi\\.org/", "").alias("doi"), c("display_name").alias("title"), c("publication_year").alias("year"), c("type").alias("docTypeRaw"),
        F.array_compact(F.array(c("language"))).alias("languages"), c("cited_by_count").alias("timesCited"), abstract_of(c("abstract_inverted_index")).alias("abstract"), c("primary_location.source.display_name").alias("source"),
        c("primary_location.source.issn").alias("issn"), c("biblio.volume").alias("volume"), c("biblio.issue").alias("issue"), F.concat_ws("-", c("biblio.first_page"), c("biblio.last_page")).alias("pages"), uniq(words).alias("indexKeywords"), uniq(areas).alias("areas"), funding.alias("funding"),
        F.transform(c("authorships"), lambda a: F.struct(a["author"]["display_name"].alias("full"), a["author"]["id"].alias("id"), F.transform(a["institutions"], lambda i: i["display_name"]).alias("affiliations"))).alias("authors"),
        F.array_distinct(F.flatten(F.transform(c("authorships"), lambda a: F.coalesce(a["countries"], F.array().cast("array<string>"))))).alias("countries"), c("referenced_works").alias("referenceIds"), c("open_access.is_oa").alias("openAccess"),
    )
