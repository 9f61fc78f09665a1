"""From records to tables: survivors of duplicates, normalised names, and the collection that indicators read.

``clean`` takes the rows of ``read_bib`` and gives a ``Cleaned`` collection: duplicates merged, authors with one key and
one label, institutions and sources with one name, filters and decisions applied. Its views (docs, authors, keywords,
references, countries, institutions) have the shapes that ``quillon.operators`` computes on.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.people import let, table
from quillon.functions.text import fold, norm_title
from quillon.operators import dedup, entities, filters
from quillon.operators.components import connected_components
from quillon.store import Stages

# fixed values: words of institution names that are shortened by cutting off their end, as title words are by ISO 4 (stem|ending)
_CUT = (
    "Acad|emy Agric|ultural Astron|omical Biol|ogy Bot|anical Chem|ical Clin|ical Coll|ege Comput|ing Econ|omics Educ|ation Electron|ics Environ|mental"
    " Geol|ogical Hosp|ital Inst|itute Int|ernational Lab|oratory Libr|ary Manag|ement Math|ematics Med|ical Minist|ry Nucl|ear Observ|atory Oceanogr|aphic"
    " Pharm|acy Phys|ics Polytech|nic Psychol|ogy Res|earch Sch|ool Sci|ence Soc|iety Technol|ogy Univ|ersity Vet|erinary"
).split()
# fixed values: words shortened in their middle
_INNER = {"assn": "Association", "ctr": "Center", "dept": "Department", "engn": "Engineering", "govt": "Government", "intl": "International", "natl": "National"}
ABBREVIATIONS = {x.split("|")[0].lower(): x.replace("|", "") for x in _CUT} | _INNER
# fixed values: articles, prepositions and conjunctions, which stay small in titles
SMALL = "a al an and at by con da das de dei del della der des di die do dos du e en et for für in la las le les los o of on para por pour the to und y zu".split()
# fixed values: fields that count for the completeness of a record
SCORED = ["title", "abstract", "doi", "source", "volume", "pages", "funding", "publisher"]
SCORED_LISTS = ["languages", "authors", "authorKeywords", "indexKeywords", "references", "areas"]
FIRST_FILLED = ["title", "source", "sourceAbbrev", "volume", "issue", "pages", "doi", "publisher", "correspondence", "docTypeRaw", "correspondingCountry", "originId", "url"]
LONGEST_TEXT = ["abstract", "funding"]
LONGEST_LIST = ["languages", "authorKeywords", "indexKeywords", "references", "areas", "affiliations"]
UNION = ["issn", "isbn", "countries"]


# institutions ---------------------------------------------------------------------------


def institution_key(name: Column) -> Column:
    """The name without case, accents and repeated blanks."""
    return F.trim(F.regexp_replace(fold(F.coalesce(name, F.lit(""))), r"\s+", " "))


def normalize_institution(name: Column) -> Column:
    """Abbreviations written out; a name in capitals gets title case. A leading [author list] and a last point go."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\[[^\]]*\]\s*|\.\s*$", ""), r"\s+", " "))
    whole = table(ABBREVIATIONS)

    def of(bare: Column) -> Column:
        words = F.transform(F.split(bare, " "), lambda w: F.coalesce(F.try_element_at(whole, F.regexp_replace(fold(w), r"\.$", "")), w))
        letters = F.regexp_replace(bare, r"[^\p{L}]", "")
        title = F.array_join(
            F.transform(F.split(F.lower(F.array_join(words, " ")), " "), lambda w, i: F.when((i > 0) & w.isin(*SMALL), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))), " "
        )
        return F.when((F.length(letters) > 4) & (letters == F.upper(letters)), title).otherwise(F.array_join(words, " "))

    return let(bare, of)


def institutions_of(affiliations: Column) -> Column:
    """Distinct normalised institutions of a list of affiliations, in order; one spelling (the first) for a key."""
    names = F.filter(F.transform(affiliations, lambda a: normalize_institution(entities.institution_of(a))), lambda x: x != "")
    return let(names, lambda n: let(F.transform(n, institution_key), lambda keys: F.filter(n, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def record_countries(rows: DataFrame) -> Column:
    """Countries of the authors and of the record, sorted."""
    own = F.filter(F.transform("authors", lambda a: a["country"]), lambda c: c.isNotNull() & (c != ""))
    return F.array_sort(F.array_distinct(F.concat(F.coalesce("countries", F.array().cast("array<string>")), own)))


# sources --------------------------------------------------------------------------------


def source_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(fold(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " "))


def issn_key(issn: Column) -> Column:
    """Eight characters of an ISSN, else null."""
    bare = F.regexp_replace(F.upper(F.coalesce(issn, F.lit(""))), "[^0-9X]", "")
    return F.when(bare.rlike("^[0-9]{7}[0-9X]$"), bare)


def source_groups(records: DataFrame) -> DataFrame:
    """(name_key, source_key, source_name) of the records' sources.

    Names that share an ISSN are one source; its key is the most used name key (ties: the smaller), its name the most
    used spelling, in mixed case if there is one, then in small letters.
    """
    rows = records.select(source_key(F.col("source")).alias("name_key"), F.trim(F.regexp_replace("source", r"\s+", " ")).alias("spelling"), "issn").where("name_key != ''")
    by_issn = rows.select("name_key", F.explode("issn").alias("issn")).select("name_key", issn_key(F.col("issn")).alias("issn")).where("issn is not null").distinct()
    star = by_issn.groupBy("issn").agg(F.min("name_key").alias("src"))
    groups = connected_components(by_issn.join(star, "issn").select("src", F.col("name_key").alias("dst"))).select(F.col("node").alias("name_key"), F.col("component").alias("root"))
    used = rows.groupBy("name_key", "spelling").agg(F.count("*").alias("n"))
    rooted = used.join(groups, "name_key", "left").withColumn("root", F.coalesce("root", "name_key"))
    keys = rooted.groupBy("root", "name_key").agg(F.sum("n").alias("n"))
    case = F.when(F.col("spelling") == F.upper("spelling"), 0).when(F.col("spelling") == F.lower("spelling"), 1).otherwise(2)
    best_key = _first(keys, "root", [F.desc("n"), F.col("name_key")], {"name_key": "source_key"})
    spelled = rooted.groupBy("root", "spelling").agg(F.sum("n").alias("n"))
    best_name = _first(spelled, "root", [case.desc(), F.desc("n"), F.col("spelling")], {"spelling": "source_name"})
    return keys.select("root", "name_key").join(best_key, "root").join(best_name, "root").select("name_key", "source_key", "source_name")


def _first(rows: DataFrame, key: str, order: list[Column], names: dict[str, str]) -> DataFrame:
    """The first row of each key in order (a window group limit: rows are cut before the shuffle)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").select(key, *[F.col(a).alias(b) for a, b in names.items()])


# survivors ------------------------------------------------------------------------------


def numbered(rows: DataFrame, stages: Stages) -> DataFrame:
    """rec, a hash of path and place (the same on every run), and seq, the order of import. ``rows`` are read twice."""
    order = F.row_number().over(Window.orderBy("path")).cast("long")  # one row a file
    files = stages.keep(rows.select("path").distinct().withColumn("_file", order), "files")
    return rows.join(files, "path").select(
        F.xxhash64("path", "position").alias("rec"), (F.col("_file") * (1 << 32) + F.col("position")).alias("seq"), *rows.columns
    )


def _filled(c: str, kind: str) -> Column:
    return F.coalesce(F.size(c) > 0 if kind.startswith("array") else (F.col(c).cast("string") != ""), F.lit(False))


def score(records: DataFrame) -> Column:
    """How complete a record is."""
    kinds = dict(records.dtypes)
    out = F.col("timesCited").isNotNull().cast("int") + F.exists("authors", lambda a: F.size(a["affiliations"]) > 0).cast("int")
    for c in SCORED + SCORED_LISTS:
        out = out + _filled(c, kinds[c]).cast("int")
    return out


def merge_groups(records: DataFrame, members: DataFrame) -> DataFrame:
    """One record for each group of ``members`` (group, rec), in the columns of ``records`` with merged and merge_log.

    Base is the most complete record (ties: the first imported). Abstract and funding take the longest text, other
    texts and the year the first filled one in order of completeness, lists the longest, authors those with most
    affiliated authors (then most authors), citations the largest, open access true if any is true, false if any is
    false; ISSN, ISBN and countries are united; the type is the first that is not other. merge_log maps a field to the
    rec it came from, where that is not the base. A group is aggregated with map-side combine, never gathered. A column
    ``_score`` has the completeness, else it is computed.
    """
    kinds = dict(records.dtypes)
    if "_score" not in records.columns:
        records = records.withColumn("_score", score(records))
    rows = members.join(records, "rec").withColumn("_s", F.col("_score")).withColumn("_q", -F.col("seq"))
    order = lambda *lead: F.struct(*[x.alias(f"o{i}") for i, x in enumerate(lead)], "_s", "_q")
    affiliated = F.size(F.filter("authors", lambda a: F.size(a["affiliations"]) > 0))
    orders = {c: order(F.coalesce(F.length(c), F.lit(0))) for c in LONGEST_TEXT}
    orders |= {c: order(_filled(c, kinds[c]).cast("int")) for c in [*FIRST_FILLED, "year"]}
    orders |= {c: order(F.coalesce(F.size(c), F.lit(0))) for c in LONGEST_LIST}
    orders |= {"authors": order(affiliated, F.size("authors")), "timesCited": order(F.coalesce("timesCited", F.lit(-1)))}
    orders["docType"] = order((F.col("docType") != "other").cast("int"))
    base = order()
    plain = [c for c in records.columns if c not in orders and c not in ("rec", "openAccess", *UNION)]
    take = [F.max_by("rec", base).alias("rec"), F.count("*").alias("merged"), F.max("openAccess").alias("openAccess")]
    take += [F.max_by(c, base).alias(c) for c in plain]
    take += [F.max_by(F.struct(F.col(c).alias("v"), F.col("rec").alias("from")), o).alias(f"_{c}") for c, o in orders.items()]
    take += [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in UNION]
    one = rows.groupBy("group").agg(*take)
    log = F.map_filter(
        F.create_map(*[x for c in orders for x in (F.lit(c), F.col(f"_{c}.from"))]), lambda k, v: v != F.col("rec")
    )
    return one.select(*[F.col(f"_{c}.v").alias(c) if c in orders else F.col(c) for c in records.columns], "merged", log.alias("merge_log"))


# the collection -------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """What a user decides in cleaning. ``decisions`` has key and decision, ``excluded`` group, aliases alias and name."""

    threshold: float = 0.95
    excluded: DataFrame | None = None
    author_merges: dict[str, str] = field(default_factory=dict)
    institution_aliases: DataFrame | None = None
    filters: filters.Filters = filters.Filters()
    decisions: DataFrame | None = None


class Cleaned:
    """Tables of a cleaned collection. ``records`` are all unique ones, ``screening`` those that pass the filters,
    ``shown`` those that decisions include (all, without decisions).

    What a table does not need is not computed: ``unique`` are the survivors as they were read, ``sourced`` have the names
    of sources besides, and names of authors and institutions are found where they are asked for. Only narrow tables are
    written (``signatures``, ``forms``, ``sources``, ``unsigned``), and ``records`` when somebody reads whole ones.
    """

    def __init__(self, stages: Stages, raw: DataFrame, groups: DataFrame, unique: DataFrame, settings: Settings):
        self.stages, self.raw, self.groups, self.unique, self.settings = stages, raw, groups, unique, settings

    @cached_property
    def sources(self) -> DataFrame:
        return self.stages.keep(source_groups(self.unique), "sources")

    @property
    def sourced(self) -> DataFrame:
        return named_sources(self.unique, self.sources)

    @cached_property
    def forms(self) -> DataFrame:
        return signature_forms(self.unique, self.settings, self.stages)

    @cached_property
    def records(self) -> DataFrame:
        return self.stages.keep(normalize(self.sourced, self.forms), "records")

    @property
    def screening(self) -> DataFrame:
        return self._screened(self.records)

    @property
    def shown(self) -> DataFrame:
        return self._shown(self.records)

    def _screened(self, records: DataFrame) -> DataFrame:
        names = {"doc_type": "docType", "source": "source_name", "cited": "timesCited"}
        return filters.apply_filters(records, self.settings.filters, names)

    @property
    def _lists(self) -> DataFrame:
        """``documents`` for tables that do not show the source: its names are found only if the filters ask for them."""
        return self._shown(self.sourced if self.settings.filters.sources else with_prisma_key(self.unique))

    def _shown(self, records: DataFrame) -> DataFrame:
        chosen = self.settings.decisions
        return self._screened(records) if chosen is None else filters.included(self._screened(records), chosen, "prisma_key")

    @property
    def documents(self) -> DataFrame:
        """``shown`` with authors and affiliations as they were read."""
        return self._shown(self.sourced)

    def stats(self) -> DataFrame:
        """One row: identified, groups, duplicates_removed, unique, filtered_out, screening, shown."""
        count = lambda df, name: df.agg(F.count("*").alias(name))
        out = count(self.raw, "identified")
        records = self.sourced if self.settings.filters.sources else with_prisma_key(self.unique)
        for df, name in ((self.groups.select("group").distinct(), "groups"), (self.unique, "unique"), (self._screened(records), "screening"), (self._lists, "shown")):
            out = out.crossJoin(F.broadcast(count(df, name)))  # rows of one number
        return out.select(
            "identified", "groups", (F.col("identified") - F.col("unique")).alias("duplicates_removed"), "unique",
            (F.col("unique") - F.col("screening")).alias("filtered_out"), "screening", "shown",
        )

    @property
    def docs(self) -> DataFrame:
        return self.documents.select(
            F.col("rec").alias("doc"), F.col("year").cast("long").alias("year"), F.nullif("source_name", F.lit("")).alias("source"), F.col("docType").alias("doc_type"),
            F.get("languages", F.lit(0)).alias("language"), F.col("timesCited").cast("long").alias("cited"),
        )

    @cached_property
    def signatures(self) -> DataFrame:
        """doc, pos, author (key), label, country, institutions; one row a signature."""
        rows = with_forms(self._lists.select(F.col("rec").alias("doc"), F.posexplode("authors").alias("pos", "a")), self.forms)
        return self.stages.keep(rows.select("doc", "pos", "key", "label", "a.country", "institutions"), "signatures")

    @property
    def institutions(self) -> DataFrame:
        """(doc, name): distinct institutions of the signatures, or of the affiliations of a document whose signatures have none."""
        signed = self.signatures.select("doc", F.explode("institutions").alias("name")).distinct()
        lone = self.unsigned.select("doc", F.explode("institutions").alias("name"))
        return signed.union(lone)

    @cached_property
    def unsigned(self) -> DataFrame:
        """(doc, institutions) of the documents whose signatures have no institution."""
        linked = self.signatures.where("size(institutions) > 0").select(F.col("doc").alias("rec")).distinct()
        lone = self._lists.select("rec", "affiliations").join(linked, "rec", "left_anti")
        return self.stages.keep(lone.select(F.col("rec").alias("doc"), institutions_of(F.col("affiliations")).alias("institutions")), "unsigned")

    @property
    def authors(self) -> DataFrame:
        return self.signatures.where("not startswith(key, '|')").select("doc", (F.col("pos") + 1).alias("pos"), F.col("key").alias("author"))

    @property
    def keywords(self) -> DataFrame:
        return self._lists.select(F.col("rec").alias("doc"), F.explode(F.when(F.size("authorKeywords") > 0, F.col("authorKeywords")).otherwise(F.col("indexKeywords"))).alias("term")).select("doc", fold("term").alias("term"))

    @property
    def references(self) -> DataFrame:
        return self._lists.select(F.col("rec").alias("doc"), F.explode("references").alias("r")).select("doc", norm_title(F.col("r.raw")).alias("ref"), F.col("r.year").cast("long").alias("year"))

    @property
    def countries(self) -> DataFrame:
        return self._lists.select(F.col("rec").alias("doc"), F.explode(record_countries(self._lists)).alias("country"))

    @property
    def docs_with_countries(self) -> DataFrame:
        """docs with countries and country: of the correspondence, else of the first author with one, else the first of the record."""
        return self.docs.join(document_country(self._lists).select("doc", "countries", "country", "basis"), "doc")


def document_country(records: DataFrame) -> DataFrame:
    """(doc, countries, country, basis, cited)."""
    own = F.filter(F.transform("authors", lambda a: a["country"]), lambda c: c.isNotNull() & (c != ""))
    how = (
        F.when(F.coalesce("correspondingCountry", F.lit("")) != "", F.struct(F.col("correspondingCountry").alias("country"), F.lit("corresponding").alias("basis")))
        .when(F.size(own) > 0, F.struct(F.get(own, F.lit(0)).alias("country"), F.lit("firstAuthor").alias("basis")))
        .when(F.size("countries") > 0, F.struct(F.get("countries", F.lit(0)).alias("country"), F.lit("affiliation").alias("basis")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("country"), F.lit("none").alias("basis")))
    )
    return records.select(F.col("rec").alias("doc"), record_countries(records).alias("countries"), how.alias("h"), F.col("timesCited").cast("long").alias("cited")).select("doc", "countries", "h.country", "h.basis", "cited")


def prisma_key(doi: Column, title: Column, year: Column) -> Column:
    """The DOI, else the title's first 150 letters and digits with the year."""
    text = F.substring(F.trim(F.regexp_replace(fold(F.coalesce(title, F.lit(""))), r"[^a-z0-9]+", " ")), 1, 150)
    bare = F.trim(F.lower(F.coalesce(doi, F.lit(""))))
    return F.when(bare != "", F.concat(F.lit("doi:"), bare)).otherwise(F.concat(F.lit("t:"), text, F.lit("|"), F.coalesce(year.cast("string"), F.lit(""))))


def with_prisma_key(records: DataFrame) -> DataFrame:
    return records.withColumn("prisma_key", prisma_key(F.col("doi"), F.col("title"), F.col("year")))


def named_sources(records: DataFrame, sources: DataFrame) -> DataFrame:
    """records with source_key, source_name (of ``source_groups``) and prisma_key."""
    return with_prisma_key(records.withColumn("name_key", source_key(F.col("source"))).join(sources, "name_key", "left").drop("name_key"))


#: Forms of signatures that are broadcast at most.
FORMS = 200_000


def _form() -> list[Column]:
    """What key, label and institutions of an author ``a`` depend on."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [text("a.last").alias("last"), text("a.initials").alias("initials"), F.coalesce("a.affiliations", F.array().cast("array<string>")).alias("places")]


def signature_forms(records: DataFrame, settings: Settings, stages: Stages) -> DataFrame:
    """(last, initials, places, key, label, institutions) of the authors' distinct names with affiliations, each named once."""
    merged = entities.resolve_merges(settings.author_merges)
    canonical = (lambda k: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in merged.items() for x in p]), k), k)) if merged else (lambda k: k)
    form = ["last", "initials", "places"]
    rows = records.select(F.explode("authors").alias("a")).select(*_form()).groupBy(*form).agg(F.count("*").alias("times"))
    rows = stages.keep(rows, "spellings")
    rows = rows.select(*form, "times", canonical(entities.author_key(F.col("last"), F.col("initials"))).alias("key"), F.trim(F.concat_ws(" ", "last", "initials")).alias("spelling"), institutions_of(F.col("places")).alias("institutions"))
    rows = stages.keep(rows, "named")
    if settings.institution_aliases is not None:
        aliases = settings.institution_aliases.select(institution_key(F.col("alias")).alias("_k"), F.col("name").alias("_to")).dropDuplicates(["_k"])
        flat = rows.select(*form, F.posexplode("institutions").alias("i", "name")).withColumn("_k", institution_key(F.col("name"))).join(aliases, "_k", "left")
        lists = flat.groupBy(*form).agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("_to", "name").alias("name")))).alias("x"))  # the institutions of one form
        lists = lists.select(*form, F.array_distinct(F.transform("x", lambda v: v["name"])).alias("aliased"))
        rows = rows.join(lists, form, "left").withColumn("institutions", F.coalesce("aliased", F.array().cast("array<string>")))
    labels = entities.vote(rows.where("key != '|'"), "key", "spelling", F.col("times")).select("key", F.col("spelling").alias("label"))
    return stages.keep(rows.join(labels, "key", "left").select(*form, "key", F.coalesce("label", "spelling").alias("label"), "institutions"), "forms")


def with_forms(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """rows(a, ...) with key, label and institutions of the author ``a``."""
    few = forms.limit(FORMS + 1).count() <= FORMS
    return rows.select("*", *_form()).join(F.broadcast(forms) if few else forms, ["last", "initials", "places"]).drop("last", "initials", "places")


def normalize(records: DataFrame, forms: DataFrame) -> DataFrame:
    """records with author keys, labels and institutions (of ``signature_forms``), and institutions."""
    named = with_forms(records.select(F.col("rec"), F.posexplode("authors").alias("pos", "a")), forms)
    author = F.struct("pos", F.col("a").withField("key", F.col("key")).withField("label", F.col("label")).withField("institutions", F.col("institutions")).alias("a"))
    lists = named.groupBy("rec").agg(F.array_sort(F.collect_list(author), lambda x, y: x["pos"] - y["pos"]).alias("x"))  # the authors of one record
    lists = lists.select("rec", F.transform("x", lambda v: v["a"]).alias("new"))
    empty = lists.schema["new"].dataType.simpleString()
    out = records.join(lists, "rec", "left").withColumn("authors", F.coalesce("new", F.array().cast(empty))).drop("new")
    of_authors = F.array_distinct(F.flatten(F.transform("authors", lambda a: a["institutions"])))
    return out.withColumn("institutions", F.when(F.size(of_authors) > 0, of_authors).otherwise(institutions_of(F.col("affiliations"))))


def clean(rows: DataFrame, settings: Settings = Settings()) -> Cleaned:  # noqa: B008
    """The collection of the rows of ``read_bib``; rows with a warning hold no record."""
    stages = Stages(rows.sparkSession, "clean")
    rows = rows.where("warning = ''")
    raw = numbered(stages.keep(rows.withColumn("_score", score(rows)), "rows"), stages)  # every field is read once for the score
    items = raw.select("rec", F.coalesce("doi", F.lit("")).alias("doi"), norm_title(F.col("title")).alias("title"), "year", entities.letters(F.get("authors", F.lit(0))["last"]).alias("surname"), F.col("path").alias("file"))
    members, _ = dedup.duplicate_groups(items, settings.threshold, settings.excluded)
    members = stages.keep(members, "members")
    single = raw.join(members.select("rec"), "rec", "left_anti").withColumn("merged", F.lit(1).cast("long")).withColumn("merge_log", F.create_map().cast("map<string,bigint>"))
    unique = single.unionByName(merge_groups(raw, members)).drop("_score")  # not written: a table reads the columns that it has
    return Cleaned(stages, raw, members, unique, settings)


def without_files(rows: DataFrame, paths: list[str]) -> DataFrame:
    """Rows of all files but those: what removing files from a collection leaves."""
    return rows.where(~F.col("path").isin(paths)) if paths else rows


# collaboration --------------------------------------------------------------------------


def collaboration_lists(cleaned: Cleaned, unit: str) -> tuple[DataFrame, DataFrame]:
    """(doc, item) of authors, institutions or countries, and (item, label) with the most used spelling (ties: the smaller)."""
    if unit == "countries":
        rows = cleaned.countries.select("doc", F.col("country").alias("item"), F.col("country").alias("label"))
    elif unit == "institutions":
        rows = cleaned.institutions.select("doc", institution_key(F.col("name")).alias("item"), F.col("name").alias("label")).where("item != ''")
    else:
        rows = cleaned.signatures.where("not startswith(key, '|')").select("doc", F.col("key").alias("item"), "label")
    return rows.select("doc", "item").distinct(), entities.vote(rows, "item", "label")


def institutions_table(cleaned: Cleaned) -> DataFrame:
    """institution, documents, appearances, share, country, rank: appearances are signatures, or documents without any linked one."""
    of_docs = cleaned.institutions.withColumn("key", institution_key(F.col("name"))).where("key != ''")
    signed = cleaned.signatures.select("doc", "country", F.explode("institutions").alias("name")).withColumn("key", institution_key(F.col("name"))).where("key != ''")
    lone = cleaned.unsigned.select(F.explode("institutions").alias("name")).withColumn("key", institution_key(F.col("name"))).where("key != ''").groupBy("key").agg(F.count("*").alias("lone"))
    docs = of_docs.groupBy("key").agg(F.countDistinct("doc").alias("documents"))
    seen = signed.groupBy("key").agg(F.count("*").alias("signed"))
    name = entities.vote(of_docs.select("key", "name", "doc").distinct(), "key", "name")
    country = entities.vote(signed.withColumn("country", F.nullif("country", F.lit(""))), "key", "country")
    total = cleaned._lists.agg(F.count("*").alias("t"))
    out = docs.join(seen, "key", "left").join(lone, "key", "left").join(name, "key").join(country, "key", "left").crossJoin(F.broadcast(total))
    out = out.withColumn("appearances", F.coalesce("signed", F.lit(0)) + F.coalesce("lone", F.lit(0)))
    return out.select(F.col("name").alias("institution"), "documents", "appearances", (F.col("documents") / F.col("t")).alias("share"), "country")


def countries_tables(cleaned: Cleaned) -> tuple[DataFrame, DataFrame, DataFrame]:
    """By country of the document (documents, scp, mcp, mcp_ratio, mean_cited); by author (appearances, documents); and (basis, n)."""
    own = document_country(cleaned._lists)
    first = own.where("country is not null").groupBy("country").agg(
        F.count("*").alias("documents"), F.count_if(F.size("countries") <= 1).alias("scp"), F.count_if(F.size("countries") > 1).alias("mcp"), F.avg("cited").alias("mean_cited")
    ).withColumn("mcp_ratio", F.col("mcp") / F.col("documents"))
    signed = cleaned._lists.select(F.col("rec").alias("doc"), F.explode("authors").alias("a")).select("doc", "a.country").where("country != ''")
    lone = cleaned._lists.where(F.forall("authors", lambda a: F.coalesce(a["country"], F.lit("")) == "")).select(F.col("rec").alias("doc"), F.explode(F.array_distinct("countries")).alias("country"))
    seen = signed.unionAll(lone).groupBy("country").agg(F.count("*").alias("appearances"))
    second = cleaned.countries.groupBy("country").agg(F.count("*").alias("documents")).join(seen, "country", "left").select("country", F.coalesce("appearances", F.lit(0)).alias("appearances"), "documents")
    return first, second, own.groupBy("basis").agg(F.count("*").alias("n"))


def country_partners(cleaned: Cleaned) -> DataFrame:
    """country, documents, international, partners, collaborations, top (the partner of most documents), top_documents."""
    lists = cleaned._lists.select(record_countries(cleaned._lists).alias("c")).where("size(c) > 0")
    each = lists.select(F.explode("c").alias("country"), (F.size("c") > 1).alias("more"))
    docs = each.groupBy("country").agg(F.count("*").alias("documents"), F.count_if("more").alias("international"))
    pairs = lists.where("size(c) > 1").select("c", F.explode("c").alias("country")).select("country", F.explode("c").alias("other")).where("country != other")
    with_other = pairs.groupBy("country", "other").agg(F.count("*").alias("n"))
    sums = with_other.groupBy("country").agg(F.count("*").alias("partners"), F.sum("n").alias("collaborations"))
    top = _first(with_other, "country", [F.desc("n"), F.col("other")], {"other": "top", "n": "top_documents"})
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.join(sums, "country", "left").join(top, "country", "left").select("country", "documents", "international", zero("partners"), zero("collaborations"), F.coalesce("top", F.lit("")).alias("top"), zero("top_documents"))
