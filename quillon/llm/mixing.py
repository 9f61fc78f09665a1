"""Soft-membership mixing to target weights.

A classifier learned from a labelled table gives each document a posterior over domains: a
naive Bayes over the hashed terms of the whole text, each counted once a document. Terms are
words in lower case, single signs of scripts without blanks, and runs of other signs.
Document rates r >= 0 are then fitted by projected gradient so that the expected domain token
totals
  sum_i r_i tokens_i P(domain | i)
match target weight x budget in least squares. The gradient of a document depends on its
posterior only, and all rates start at 1; copies of a text therefore keep equal rates, and
summing their tokens first loses nothing. Residuals are weighed by the inverse of
sum tokens p p' (then a step of 1 is safe), which changes nothing if the targets can be
met. Every step is one aggregation over the table of distinct texts.

A rate becomes whole copies: its floor, and one more with the probability of its fraction,
decided by a hash of the id and text.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.exprs import fresh
from quillon.store import Stages

STEPS = 100
TOLERANCE = 1e-3
#: A step that lessens the residual by a smaller share than this ends the descent.
PROGRESS = 1e-4
BROADCAST_CELLS = 100_000
BUCKETS = 1 << 16
SMOOTHING = 0.1
TERM = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]+"

log = logging.getLogger(__name__)


def text_keys(text: Column) -> list[Column]:
    """Two hashes that name a text; a null one counts as empty."""
    own = F.coalesce(text, F.lit(""))
    return [F.xxhash64(own).alias("_k1"), F.xxhash64(F.lit(1), own).alias("_k2")]


def terms_of(text: Column) -> Column:
    """The distinct buckets of a text's terms."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))
    return F.array_distinct(F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


class DomainModel:
    """log P(domain), and a table (bucket, l0, l1, ..) of log P(term | domain), BUCKETS rows at most."""

    def __init__(self, domains: list[str], prior: list[float], weights: DataFrame | None):
        self.domains, self.prior, self.weights = domains, prior, weights

    def cells(self, rows: DataFrame) -> DataFrame:
        """(_k1, _k2, tokens, p) of rows(_k1, _k2, tokens, terms): one row a text, p the array of posteriors.

        Terms without a labelled document say nothing.
        """
        keys, d = ["_k1", "_k2"], range(len(self.domains))
        if not self.domains:
            return rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens")).withColumn("p", F.array().cast("array<double>"))
        numbered = rows.withColumn("row", F.monotonically_increasing_id())  # before the terms are unfolded: one number a row
        each = numbered.select("row", *keys, "tokens", F.explode_outer("terms").alias("bucket"))
        sums = [F.coalesce(F.sum(f"l{i}"), F.lit(0.0)).alias(f"l{i}") for i in d]
        of_row = each.join(F.broadcast(self.weights), "bucket", "left").groupBy("row", *keys, "tokens").agg(*sums)
        of_text = of_row.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), *[F.min(f"l{i}").alias(f"l{i}") for i in d])
        logs = of_text.select(*keys, "tokens", F.array(*[F.col(f"l{i}") + self.prior[i] for i in d]).alias("l")).withColumn("m", F.array_max("l"))
        e = logs.select(*keys, "tokens", F.transform("l", lambda x: F.exp(x - F.col("m"))).alias("e"))
        e = e.withColumn("s", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
        return e.select(*keys, "tokens", F.transform("e", lambda x: x / F.col("s")).alias("p"))


def fit_domains(rows: DataFrame, labelled: DataFrame, stages: Stages) -> DomainModel:
    """rows has doc_id and terms; labelled has doc_id and domain (one of few). All labelled rows count.

    Null ids and domains teach nothing; an id labelled twice counts as its first domain in order.
    """
    own = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    taught = rows.select("doc_id", "terms").join(own, "doc_id")
    found = taught.groupBy("domain").agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("all")).orderBy("domain").collect()
    domains = [r["domain"] for r in found]
    if not domains:
        return DomainModel([], [], None)
    counts = stages.keep(
        taught.select("domain", F.explode("terms").alias("bucket")).groupBy("bucket")
        .agg(*[F.count(F.when(F.col("domain") == x, 1)).alias(f"n{i}") for i, x in enumerate(domains)]), "counts",
    )
    known = counts.count()
    weights = [
        (F.log(F.col(f"n{i}") + SMOOTHING) - math.log((r["all"] + SMOOTHING * known) or 1.0)).alias(f"l{i}") for i, r in enumerate(found)
    ]
    every = sum(r["n"] for r in found) + len(found)
    return DomainModel(domains, [math.log((r["n"] + 1) / every) for r in found], counts.select("bucket", *weights))


def fit_rates(cells: DataFrame, n_domains: int, weights: list[float], budget: float | None = None) -> tuple[Column, list[float]]:
    """The rate as an expression of column p, and the expected totals reached.

    cells has p (posterior) and tokens, one row for documents of equal p. budget defaults
    to all tokens. Cells without tokens weigh nothing. The residual and the number of steps
    are logged, as a warning if the descent was cut at ``STEPS``.
    """
    d = range(n_domains)
    p = [F.col("p")[i] for i in d]
    first = cells.agg(
        F.sum("tokens").alias("all"), *[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"h{i}_{j}") for i in d for j in d if j >= i]
    ).first()
    everything = float(first["all"] or 0)
    goal = np.array(weights, float) / (sum(weights) or 1.0) * (budget if budget is not None else everything)
    if not everything or not n_domains:
        return F.lit(1.0), [0.0] * n_domains
    h = np.array([[first[f"h{min(i, j)}_{max(i, j)}"] for j in d] for i in d], float)
    inverse = np.linalg.pinv(h, rcond=1e-9, hermitian=True)
    moves: list[list[float]] = []

    def rate() -> Column:
        if not moves:
            return F.lit(1.0)
        steps = F.array(*[F.array(*map(F.lit, m)) for m in moves])
        dot = lambda m: F.aggregate(F.zip_with(F.col("p"), m, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return F.aggregate(steps, F.lit(1.0), lambda r, m: F.greatest(F.lit(0.0), r - dot(m)))

    last = math.inf
    for _ in range(STEPS + 1):
        row = cells.select("tokens", "p", rate().alias("r")).agg(*[F.sum(F.col("tokens") * F.col("r") * p[i]).alias(f"s{i}") for i in d]).first()
        reached = np.array([row[f"s{i}"] for i in d], float)
        miss = reached - goal
        error = float(np.sqrt(max(miss @ inverse @ miss, 0.0) / everything))
        settled = error < TOLERANCE or last - error < PROGRESS * error
        if settled or len(moves) == STEPS:
            log.log(logging.INFO if settled else logging.WARNING, "rates: residual %.6f after %d steps, settled: %s", error, len(moves), settled)
            break
        last = error
        moves.append([float(x) for x in inverse @ miss])
    return rate(), [float(x) for x in reached]


def mix_to_targets(docs: DataFrame, labelled: DataFrame, target, id_col: str = "doc_id", text_col: str = "text", budget: float | None = None) -> DataFrame:
    """``docs`` with _tokens, _domain, _rate and _copies.

    ``target`` gives a domain's weight, from its name. A null or empty text has no tokens
    and the rate of the prior. Repeated rows and null ids keep their rows. If no row is
    labelled, all rates are 1 and the domain is null. Columns of ``docs`` called _tokens, _domain,
    _rate or _copies are replaced; all others stay, whatever their names. Very long texts count
    whole. Empty tables give no rows.
    """
    stages = Stages(docs.sparkSession, "mixing")
    text = F.col(text_col)
    n_tokens = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")
    rows = stages.keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_keys(text), n_tokens.alias("tokens"), terms_of(text).alias("terms")), "rows")
    model = fit_domains(rows, labelled, stages)
    n = len(model.domains)
    cells = stages.keep(model.cells(rows), "cells")
    rate, _ = fit_rates(cells, n, [target(x) for x in model.domains], budget)
    names = F.array(*map(F.lit, model.domains)) if n else F.array().cast("array<string>")
    best = F.get(names, (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    rates = stages.keep(cells.select("_k1", "_k2", best.alias("_domain"), F.round(rate, 6).alias("_rate")), "rates")
    plain = docs.drop("_tokens", "_domain", "_rate", "_copies")
    k1, k2, lot = fresh([*docs.columns, "_tokens", "_domain", "_rate", "_copies"], "_k1", "_k2", "_lot")
    few = rates.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    rates = rates.withColumnsRenamed({"_k1": k1, "_k2": k2})
    rates = F.broadcast(rates) if few else rates
    chance = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(1_000_000)) / 1_000_000
    keys = [key.alias(name) for key, name in zip(text_keys(text), (k1, k2), strict=True)]
    out = plain.select("*", n_tokens.alias("_tokens"), *keys, chance.alias(lot)).join(rates, [k1, k2], "left")
    copies = (F.floor("_rate") + (F.col(lot) < F.col("_rate") - F.floor("_rate")).cast("long")).cast("long")
    stages.drop("rows", "counts", "cells")
    return out.select(*[F.col(f"`{c}`") for c in plain.columns], "_tokens", "_domain", "_rate", copies.alias("_copies"))


def domains_from(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the query: language and quality of the labelled documents."""
    return (
        docs.select("doc_id", "lang").join(labels.select("doc_id", "quality"), "doc_id")
        .select("doc_id", F.concat_ws("-", F.col("lang"), F.col("quality").cast("string")).alias("domain")).where("lang is not null and quality is not null")
    )


def target_weight(domain: str) -> float:
    """Good text of every language alike, with a tenth as much poor text."""
    return 1.0 if domain.endswith("-1") else 0.1
