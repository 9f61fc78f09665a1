"""Terms of documents: stop words, synonyms, counts, growth, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import bigrams, fold, title_similarity, tokens
from quillon.operators.components import connected_components
from quillon.operators.entities import vote

# fixed values: a short English and Spanish stop list
STOP_WORDS = "a al an and are as at be by con de del el en es for from has in is it la las lo los of on or para por que se that the their this to un una was were which with y".split()


def long_tokens(docs: DataFrame, text: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, term) of all words, in every occurrence."""
    return docs.select(F.col(doc).alias("doc"), F.explode(tokens(F.col(text))).alias("term"))


def long_bigrams(docs: DataFrame, stop: list[str] = STOP_WORDS, text: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, term) of the pairs of neighbouring words."""
    words = docs.select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("words"))
    return words.select("doc", F.explode(bigrams(F.col("words"), stop)).alias("term"))


def clean_terms(terms: DataFrame, stop: list[str] = (), synonyms: dict[str, str] | None = None) -> DataFrame:
    """(doc, term, label): folded keys; stop words out, synonyms resolved once, stop words and repeats out again."""
    keyed = terms.select("doc", fold(F.col("term")).alias("key"), F.col("term").alias("label"))
    banned = [*stop]
    if banned:
        keyed = keyed.where(~F.col("key").isin(*banned))
    if synonyms:
        pairs = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
        new = F.try_element_at(pairs, F.col("key"))
        keyed = keyed.withColumns({"label": F.coalesce(new, "label"), "key": F.coalesce(new, "key")})
        if banned:
            keyed = keyed.where(~F.col("key").isin(*banned))
    return keyed.groupBy("doc", "key").agg(F.min("label").alias("label")).withColumnRenamed("key", "term")


def term_counts(terms: DataFrame) -> DataFrame:
    """(term, n, label): documents that have the term, and its most frequent spelling."""
    n = terms.groupBy("term").agg(F.countDistinct("doc").alias("n"))
    return n.join(vote(terms, "term", "label"), "term", "left")


def synonym_suggestions(counts: DataFrame, threshold: float = 0.9) -> DataFrame:
    """counts(term, n): (group, term) of terms that are equal without separators and plural endings, or
    neighbours in order (two apart at most, within the first 3 letters) that are nearly the same."""
    squash = F.regexp_replace(F.regexp_replace("term", r"[\s-]+", ""), "(?:es|s)$", "")
    same = counts.withColumn("squash", squash)
    first = same.groupBy("squash").agg(F.min("term").alias("src"), F.count("*").alias("k")).where("k > 1")
    links = same.join(first, "squash").select("src", F.col("term").alias("dst"))
    w = Window.partitionBy(F.substring("term", 1, 3)).orderBy("term")
    near = counts.select("term", F.array(F.lead("term", 1).over(w), F.lead("term", 2).over(w)).alias("others"))
    near = near.select("term", F.explode("others").alias("other")).where("other is not null")
    near = near.where(title_similarity(F.col("term"), F.col("other"), threshold) >= threshold).select(F.col("term").alias("src"), F.col("other").alias("dst"))
    found = connected_components(links.union(near))
    return found.select(F.col("component").alias("group"), F.col("node").alias("term"))


def first_field_with_data(docs: DataFrame, fields: list[str]) -> str | None:
    """The first of the list columns that has a value in any row."""
    row = docs.agg(*[F.max(F.coalesce(F.size(c), F.lit(0))).alias(c) for c in fields]).first()
    return next((c for c in fields if (row[c] or 0) > 0), None)
