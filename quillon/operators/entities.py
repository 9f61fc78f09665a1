"""Authors, institutions, sources: keys, variants, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.people import let
from quillon.functions.text import fold
from quillon.operators.components import connected_components

# fixed values: words that mark institutions and their parts (English, Spanish, French, German, Portuguese, Italian)
TOP_WORDS = "academy academia college ecole hochschule hospital hopital klinikum politecnico polytechnic polytechnique school univ universidad universidade universita universitat universite universiteit university".split()
UNIT_WORDS = "abteilung area catedra dept departamento departement department div division escuela fac facultad faculdade faculte faculty fakultat group grupo lab laboratorio laboratory program programa seccion section unidad unit".split()
CENTRE_WORDS = "agency association centre center centro company corporation foundation fundacion institut institute instituto ministry museum observatory".split()


def letters(c: Column) -> Column:
    return F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}]+", "")


def author_key(last: Column, initials: Column) -> Column:
    return F.concat_ws("|", letters(last), letters(initials))


def vote(rows: DataFrame, key: str, label: str, times: Column | None = None) -> DataFrame:
    """(key, label): the most frequent label, ties by its order. ``times``: how often a row counts (once)."""
    n = rows.where(F.col(label).isNotNull()).groupBy(key, label).agg((F.count("*") if times is None else F.sum(times)).alias("n"))
    best = n.groupBy(key).agg(F.max("n").alias("n"))
    return n.join(best, [key, "n"]).groupBy(key).agg(F.min(label).alias(label))


def author_variants(rows: DataFrame) -> DataFrame:
    """rows(doc, key): keys of one surname and first initial with two or more spellings.

    (family, key, n, shared): documents, and co-authors shared with the family's most frequent key.
    """
    once = rows.where("key is not null").distinct()
    family = F.concat(F.substring_index("key", "|", 1), F.lit("|"), F.substring(F.substring_index("key", "|", -1), 1, 1))
    keys = once.groupBy("key").agg(F.count("*").alias("n")).withColumn("family", family)
    size = keys.groupBy("family").agg(F.count("*").alias("k"), F.max(F.struct("n", "key")).alias("m")).where("k > 1")
    many = keys.join(size.select("family", F.col("m.key").alias("main")), "family")
    mates = once.join(many.select("key", "family", "main"), "key").join(once.select("doc", F.col("key").alias("mate")), "doc").where("mate != key").select("family", "main", "key", "mate").distinct()
    main = mates.where("key = main").select("family", "mate")
    shared = mates.where("key != main").join(main, ["family", "mate"]).groupBy("family", "key").agg(F.count("*").alias("shared"))
    return many.join(shared, ["family", "key"], "left").select("family", "key", "n", F.coalesce("shared", F.lit(0)).alias("shared"))


def resolve_merges(merges: dict[str, str], hops: int = 20) -> dict[str, str]:
    """Follows a user's merge map to its ends; a cycle stops after ``hops``."""
    out = {}
    for start in merges:
        now = start
        for _ in range(hops):
            if now not in merges:
                break
            now = merges[now]
        out[start] = now
    return out


def _has(part: Column, words: list[str]) -> Column:
    return fold(part).rlike(r"\b(?:" + "|".join(words) + r")")


def institution_of(affiliation: Column) -> Column:
    """The part that names the institution: a top one that is no subunit, else a top one, a centre,
    the first part of three words without a digit, or the first that is no subunit."""
    digit = lambda p: p.rlike(r"\d")

    def of(parts: Column) -> Column:
        pick = lambda test: F.get(F.filter(parts, test), F.lit(0))
        first = F.get(parts, F.lit(0))
        return F.coalesce(
            pick(lambda p: _has(p, TOP_WORDS) & ~_has(p, UNIT_WORDS)), pick(lambda p: _has(p, TOP_WORDS)), pick(lambda p: _has(p, CENTRE_WORDS)),
            F.when((F.size(F.split(first, r"\s+")) >= 3) & ~digit(first), first), pick(lambda p: ~_has(p, UNIT_WORDS) & ~digit(p)),
        )

    return let(F.filter(F.transform(F.split(affiliation, "[,;]"), lambda p: F.trim(p)), lambda p: p != ""), of)


def source_groups(rows: DataFrame) -> DataFrame:
    """rows(name, issn): (name, source) where names that share an ISSN are one source, called by its most used name."""
    used = rows.where("name is not null").groupBy("name").agg(F.count("*").alias("n"))
    star = rows.where("name is not null and issn is not null").groupBy("issn").agg(F.min("name").alias("src"))
    links = rows.join(star, "issn").select("src", F.col("name").alias("dst")).distinct()
    groups = connected_components(links).select(F.col("node").alias("name"), "component")
    full = used.join(groups, "name", "left").withColumn("component", F.coalesce("component", "name"))
    w = Window.partitionBy("component").orderBy(F.desc("n"), "name")
    return full.select("name", F.first("name").over(w).alias("source"))


def apply_aliases(rows: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """aliases(alias, name): a listed spelling takes the user's name."""
    named = aliases.select(F.col("alias").alias(column), F.col("name").alias("_name")).dropDuplicates([column])
    return rows.join(named, column, "left").withColumn(column, F.coalesce("_name", column)).drop("_name")
