"""Language identification by Bayesian evidence fusion.

The text gives a likelihood per language: naive Bayes over hashed byte 3-grams and words,
learned from ``SAMPLE`` labelled texts at most, tempered so that long texts do not drown all
other evidence (n-grams overlap and are not independent). Declared markup language,
address suffix and host add their own terms, each learned from all rows by grouped
aggregation of the text posteriors:
  P(declared | language), P(suffix | language)   with additive smoothing
  P(language | host)                             smoothed towards the parent domain, that
                                                 towards its suffix, that towards all rows
Missing evidence adds nothing. Below ``DOUBT`` the language is ``und``.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.textvec import NOT_LETTER, Words, mix, pieces
from quillon.store import Stages

BUCKETS = 1 << 16
SAMPLE = 20_000
TEMPER = 0.25
MOST = 400.0
STRENGTH = 20.0
DOUBT = 0.5
BROADCAST_HOSTS = 100_000


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the words, and of the 3-grams inside words and at their ends."""
    words = Words(data, offsets, NOT_LETTER)
    if not len(words.starts):
        return words.row, np.zeros(0, np.int64)
    shift = np.uint64(48)
    letters = np.where(NOT_LETTER[words.data], 32, words.data).astype(np.uint64)
    lone = np.r_[letters[:1] * 0 + 32, letters, 32]
    key = lone[:-2] << np.uint64(16) | lone[1:-1] << np.uint64(8) | lone[2:]
    middle = np.flatnonzero(letters != 32)
    row = np.searchsorted(offsets, middle, "right") - 1
    grams = (mix(key[middle], 21) >> shift).astype(np.int64)
    return np.r_[words.row, row], np.r_[(words.hashes >> shift).astype(np.int64), grams]


class TextModel:
    """log P(bucket | language) and the languages' names."""

    def __init__(self, langs: list[str], counts: np.ndarray, prior: np.ndarray):
        self.langs = langs
        smooth = counts + 0.05
        self.logp = np.log(smooth / smooth.sum(0, keepdims=True)).astype(np.float32)
        self.prior = prior

    def likelihood(self, column: pa.Array) -> np.ndarray:
        """Tempered log likelihoods, less the row's maximum; zeros for a text without letters."""
        column = pc.utf8_lower(pc.fill_null(column, ""))
        out = np.zeros((len(column), len(self.langs)))
        for first, end, data, offsets in pieces(column):
            row, bucket = _features(data, offsets)
            n = np.bincount(row, minlength=end - first)
            scale = np.minimum(TEMPER, MOST / np.maximum(n, 1))
            for i in range(len(self.langs)):
                out[first:end, i] = np.bincount(row, self.logp[bucket, i], end - first) * scale
        return out - out.max(1, keepdims=True) if len(self.langs) else out


def fit_text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> TextModel:
    """Counts over ``sample`` rows with a language, chosen by a hash of the text."""
    chosen = (
        docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null and text != ''")
    )
    total = chosen.count()
    if total > sample:
        # a share of the hash range; the bound holds up to the hash's evenness and copies
        chosen = chosen.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    langs = sorted(r[0] for r in chosen.select("lang").distinct().collect())  # one row a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            of = {x: i for i, x in enumerate(langs)}
            which = np.array([of[x] for x in batch.column(1).to_pylist()], np.int64)
            column = pc.utf8_lower(batch.column(0))
            for first, _, data, offsets in pieces(column):
                row, bucket = _features(data, offsets)
                np.add.at(total, (which[first + row], bucket), 1)
        i, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(b, pa.int32()), pa.array(total[i, b])], ["i", "b", "n"])

    rows = chosen.mapInArrow(count, "i int, b int, n long").groupBy("i", "b").agg(F.sum("n").alias("n")).toPandas()  # languages x BUCKETS at most
    counts = np.zeros((BUCKETS, len(langs)))
    counts[rows["b"], rows["i"]] = rows["n"]
    share = chosen.groupBy("lang").count().toPandas().set_index("lang")["count"]
    prior = np.array([float(share.get(x, 0)) + 1 for x in langs])
    return TextModel(langs, counts, prior / max(prior.sum(), 1.0))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True)) if x.size else x
    return e / e.sum(1, keepdims=True) if x.size else x


def identify(rows: DataFrame, model: TextModel, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang, score and text_lang per row of ``rows``.

    rows has text, declared, suffix and host beside the ``keep`` columns; any may be null
    (declared is lower-cased and cut at the first hyphen). Character references are decoded
    where a column markup is true. Very long texts count whole; of equally likely languages the
    first in order holds. Columns other than these are not read. Rows are judged one by one, repeated ones
    too. Without letters and other evidence the score is the prior's and the language und;
    the same holds if the model knows no language. Empty tables give no rows.
    """
    spark, langs, n = rows.sparkSession, model.langs, len(model.langs)
    if not n:
        return rows.select(*keep, F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit("und").alias("text_lang"))
    stages = Stages(spark, "langid")
    spread = spark.sparkContext.broadcast(model)
    clean = rows.select(
        *keep, F.split(F.lower("declared"), "[-_]")[0].alias("declared"), F.lower("suffix").alias("suffix"), F.lower("host").alias("host"), (F.col("markup") if "markup" in rows.columns else F.lit(False)).alias("markup"), "text"
    )
    names = clean.columns[:-2]
    at = len(names)
    kinds = {f.name: f for f in clean.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in names) + ", ll array<double>, p array<double>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        for batch in batches:
            texts = batch.column(at + 1)
            coded = np.flatnonzero(np.asarray(pc.and_(batch.column(at).fill_null(False), pc.fill_null(pc.match_substring(texts, "&"), False)).to_numpy(zero_copy_only=False)))
            if len(coded):
                plain = texts.to_pylist()
                for i in coded.tolist():
                    plain[i] = entities.unescape(plain[i])
                texts = pa.array(plain, pa.string())
            ll = own.likelihood(texts)
            p = _softmax(ll + np.log(own.prior))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, n), pa.int32()), pa.array(x.ravel())) for x in (ll, p)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *lists], [*names, "ll", "p"])

    read_rows = stages.keep(clean.mapInArrow(read, schema), "read")
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]

    def table(df: DataFrame, key: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(key).agg(*sums)

    whole = read_rows.agg(*sums).first()
    total = np.array([whole[f"s{i}"] or 0.0 for i in range(n)]) + 1.0
    base = total / total.sum()

    def evidence(key: str, to: str) -> DataFrame:
        """(key, to): the sums of every value."""
        return small(stages.keep(table(read_rows, key).select(key, F.array(*[F.col(f"s{i}") for i in range(n)]).alias(to)), to))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else df

    # host -> parent domain -> suffix -> all rows
    parent = lambda c: F.when(F.instr(c, ".") > 0, F.regexp_extract(c, r"([^.]+\.[^.]+)$", 1)).otherwise(F.lit(""))
    top = lambda c: F.regexp_extract(c, r"([^.]*)$", 1)
    hosts = table(read_rows, "host").withColumn("parent", parent(F.col("host"))).withColumn("top", top(F.col("host")))
    level = lambda key: hosts.groupBy(key).agg(*[F.sum(f"s{i}").alias(f"{key}{i}") for i in range(n)])
    hosts = hosts.join(level("parent"), "parent").join(level("top"), "top")
    levels = ("s", "parent", "top")
    hosts = hosts.select("host", *[F.array(*[F.col(f"{x}{i}") for i in range(n)]).alias(f"of_{x}") for x in levels])
    hosts = small(stages.keep(hosts, "hosts"))
    known = read_rows.join(hosts, "host", "left").join(evidence("declared", "of_declared"), "declared", "left").join(evidence("suffix", "of_suffix"), "suffix", "left")
    p = [F.col("p")[i] for i in range(n)]
    # what other rows say: less the row's own posterior (a sum may fall under 0 by rounding)
    rest = lambda c, i: F.greatest(F.col(c)[i] - p[i], F.lit(0.0))

    def blend(level: str, i: int, up: Column) -> Column:
        mass = rest(f"of_{level}", 0)
        for j in range(1, n):
            mass = mass + rest(f"of_{level}", j)
        return (rest(f"of_{level}", i) + STRENGTH * up) / (mass + STRENGTH)

    def says(c: str, i: int) -> Column:
        return F.when(F.col(c).isNotNull(), F.log((rest(c, i) + 0.5) / (F.lit(float(total[i])) - p[i]))).otherwise(0.0)

    host = [
        F.when(F.col("of_s").isNotNull(), F.log(blend("s", i, blend("parent", i, blend("top", i, F.lit(float(base[i]))))) / float(model.prior[i]))).otherwise(0.0)
        for i in range(n)
    ]
    logs = [F.col("ll")[i] + host[i] + says("of_declared", i) + says("of_suffix", i) + float(np.log(model.prior[i])) for i in range(n)]
    scored = known.select(*keep, "p", F.array(*logs).alias("l")).withColumn("m", F.array_max("l"))
    scored = scored.withColumn("e", F.transform("l", lambda x: F.exp(x - F.col("m"))))
    score = 1 / F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    every = F.array(*map(F.lit, langs))
    best = F.get(every, (F.array_position("l", F.col("m")) - 1).cast("int"))
    text_best = F.get(every, (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    return scored.select(
        *keep, F.when(score >= DOUBT, best).otherwise("und").alias("lang"), F.round(score, 6).alias("score"), text_best.alias("text_lang")
    )


def rows_of(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Pages and documents in one shape: pages declare a language, documents have their source for a host."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    text = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)|<!--.*?-->|<[^>]*>", " ")
    null = F.lit(None).cast("string")
    of_pages = pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"),
        F.nullif(F.regexp_extract(F.col("html"), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1), F.lit("")).alias("declared"),
        F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")).alias("suffix"), F.nullif(host, F.lit("")).alias("host"), F.lit(True).alias("markup"), text.alias("text"),
    )
    of_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), null.alias("declared"), null.alias("suffix"), F.col("source").alias("host"), F.lit(False).alias("markup"), F.col("text").alias("text"))
    return of_pages.unionByName(of_docs)
