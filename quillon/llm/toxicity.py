"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-cased words and their leading 3 to 6 bytes (so that an inflected
form shares a term with its stem), hashed to ``BUCKETS``. The machine scores
sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the terms it knows: the factors v learn
what a pair of terms adds, such as an insult together with the mention of a group, which
linear weights cannot express.

Fitting takes ``SAMPLE`` labelled rows at most, chosen by a hash of the id; rows whose
crc32(id as text) mod 5 is 0 are held out. Over that sample, buckets are counted by a
distributed aggregation. The machine knows the ``FEATURES`` buckets with the highest
log-likelihood ratio (over ``EVIDENCE``), and the terms of pairs that tell more than either of
them: pairs of the ``PAIRED`` buckets in most texts (those in over half of them set aside) are
counted over the sample, and a pair whose ratio is ``PAIR_EVIDENCE`` over that of its better
term brings both in, up to ``PAIR_FEATURES``. So a term that says nothing by itself, such as
a group mention, can enter an interaction. Labels, language, source and id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.textvec import NOT_LETTER, Words, distinct_by_row, pieces
from quillon.store import Stages

BUCKETS = 1 << 22
SAMPLE = 30_000
FEATURES = 8192
PAIRED = 2048
PAIR_EVIDENCE = 30.0
PAIR_FEATURES = 512
EVIDENCE = 15.0
FACTORS = 8
EPOCHS = 60
STEMS = (3, 4, 5, 6)


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from learning; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each, distinct buckets) by piece."""
    column = pc.utf8_lower(pc.fill_null(column, ""))
    for first, end, data, offsets in pieces(column):
        words = Words(data, offsets, NOT_LETTER, lower=False)
        size = words.ends - words.starts
        rows, hashes = [words.row], [words.hashes]
        for k in STEMS:
            long = size > k
            rows.append(words.row[long])
            hashes.append(words.span_hash(words.starts[long], words.starts[long] + k) ^ np.uint64(k))
        bucket = np.concatenate(hashes) >> np.uint64(64 - (BUCKETS.bit_length() - 1))
        yield (first, end, *distinct_by_row(np.concatenate(rows), bucket.astype(np.int64)))


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns label, text -> label, terms."""
    for batch in batches:
        for first, end, rows, bucket in _terms(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), _lists(rows, bucket, end - first)], ["label", "terms"])


class FactorizationMachine:
    """Degree-2 machine on sets of known buckets, fitted by Adagrad on log loss."""

    def __init__(self, known: np.ndarray, factors: int = FACTORS, seed: int = 1):
        self.known = np.sort(known)
        rng = np.random.default_rng(seed)
        self.b = 0.0
        self.w = np.zeros(len(known) + 1)
        self.v = rng.normal(0, 0.01, (len(known) + 1, factors))
        self.v[-1] = 0

    def index(self, buckets: np.ndarray) -> np.ndarray:
        """Places of the buckets that are known."""
        at = np.searchsorted(self.known, buckets)
        at[at == len(self.known)] = 0
        return at[self.known[at] == buckets] if len(self.known) else at[:0]

    def raw(self, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Scores before the sigmoid of n sets given as (row, place) pairs."""
        linear = np.bincount(rows, self.w[at], n)
        s = np.stack([np.bincount(rows, self.v[at, f], n) for f in range(self.v.shape[1])], 1)
        q = np.bincount(rows, (self.v[at] ** 2).sum(1), n)
        return self.b + linear + 0.5 * ((s**2).sum(1) - q)

    def fit(self, rows: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.2, ridge: float = 1e-5) -> FactorizationMachine:
        """rows are sorted; y has a 0 or 1 for each row number."""
        n = len(y)
        if not n:
            return self
        share = np.clip(y.mean(), 1 / (n + 2), 1 - 1 / (n + 2))
        self.b = float(np.log(share / (1 - share)))
        gw, gv, gb = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        cut = np.searchsorted(rows, np.arange(n + 1))
        batch = max(32, min(512, n // 20))
        rng = np.random.default_rng(2)
        for _ in range(epochs):
            order = rng.permutation(n)
            for start in range(0, n, batch):
                take = np.sort(order[start : start + batch])
                size = cut[take + 1] - cut[take]
                place = np.repeat(cut[take] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                i, r = at[place], np.repeat(np.arange(len(take)), size)
                miss = 1 / (1 + np.exp(-np.clip(self.raw(r, i, len(take)), -30, 30))) - y[take]
                s = np.stack([np.bincount(r, self.v[i, f], len(take)) for f in range(self.v.shape[1])], 1)
                dw = np.bincount(i, miss[r], len(self.w)) / len(take) + ridge * self.w
                dv = np.zeros_like(self.v)
                np.add.at(dv, i, miss[r, None] * (s[r] - self.v[i]))
                dv = dv / len(take) + ridge * self.v
                db = miss.mean()
                gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
                self.w -= rate * dw / np.sqrt(gw)
                self.v -= rate * 0.3 * dv / np.sqrt(gv)
                self.b -= rate * db / np.sqrt(gb)
        return self


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> FactorizationMachine:
    """The machine fitted on ``sample`` labelled rows that are not held out.

    Rows with a null id or label teach nothing; an id labelled twice counts as its highest
    label, an id with several texts teaches by one of them. Without labels of both kinds the machine knows no term and scores the base rate.
    """
    stages = Stages(docs.sparkSession, "toxicity")
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        .where(F.col("label").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("label").cast("double").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    # ``sample`` rows of two numbers: bounded, so that it may be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # an id on many rows teaches by one of them, so that no more than ``sample`` rows go on
    first = texts.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text")))["text"].alias("text"))
    terms = stages.keep(first.select("label", "text").mapInArrow(_featurize, "label double, terms array<int>"), "terms")
    total = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("p")).first()
    n, p = float(total["n"]), float(total["p"])
    if n == 0 or p == 0 or p == n:
        machine = FactorizationMachine(np.zeros(0, np.int64))
        machine.b = float(np.log((p + 1) / (n - p + 1)))
        return machine
    d = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    a, b = F.col("pos"), F.col("n") - F.col("pos")
    c, e = F.lit(p) - a, F.lit(n - p) - b
    ratio = 2 * (d(a) + d(b) + d(c) + d(e) - d(a + b) - d(c + e) - d(a + c) - d(b + e) + d(a + b + c + e))
    counted = stages.keep(
        terms.select("label", F.explode("terms").alias("bucket")).groupBy("bucket")
        .agg(F.count("*").cast("double").alias("n"), F.sum("label").alias("pos")).where("n >= 3").withColumn("ratio", ratio), "counted",
    )
    telling = counted.where(F.col("ratio") >= EVIDENCE).orderBy(F.desc("ratio"), "bucket").limit(FEATURES)
    frequent = counted.where(F.col("n") <= n / 2).orderBy(F.desc("n"), "bucket").limit(PAIRED)
    best, often = (np.sort(x.select("bucket").toPandas()["bucket"].to_numpy(np.int64)) for x in (telling, frequent))  # FEATURES and PAIRED rows at most
    # all of the sample's pairs are counted by one task: ``sample`` rows of PAIRED terms at most
    pairs = _only(terms, often).repartition(1).mapInArrow(_pair_finder(often, p, n), "bucket long")
    machine = FactorizationMachine(np.union1d(best, pairs.toPandas()["bucket"].to_numpy(np.int64)))  # PAIR_FEATURES rows more at most
    # at most ``sample`` rows; sorted, so that the fit does not depend on the order of tasks
    data = _only(terms, machine.known).toPandas()
    data = data.assign(key=[(y, tuple(t)) for y, t in zip(data["label"], data["terms"], strict=True)]).sort_values("key", ignore_index=True)
    stages.drop("terms", "counted")
    sets = [np.asarray(t, np.int64) for t in data["terms"]]
    rows = np.repeat(np.arange(len(sets)), [len(t) for t in sets])
    flat = np.concatenate(sets) if len(rows) else np.zeros(0, np.int64)
    return machine.fit(rows, np.searchsorted(machine.known, flat), data["label"].to_numpy())


def _only(terms: DataFrame, known: np.ndarray) -> DataFrame:
    """(label, terms) with the terms among ``known`` (sorted) only."""
    spread = terms.sparkSession.sparkContext.broadcast(known)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = np.asarray(lists.flatten()).astype(np.int64)
            rows = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            keep = np.isin(flat, spread.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(rows[keep], flat[keep], len(lists))], ["label", "terms"])

    return terms.mapInArrow(reduce, "label double, terms array<int>")


def _pair_finder(often: np.ndarray, all_pos: float, every: float):
    """Columns label, terms -> the terms among ``often`` (sorted) whose pairs tell PAIR_EVIDENCE more than either of them."""
    k = len(often)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, toxic = np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                lists = part.column(1)
                x = np.zeros((len(lists), k), np.float32)
                x[np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets))), np.searchsorted(often, np.asarray(lists.flatten()))] = 1
                both += x.T @ x
                bad = x[np.asarray(part.column(0)) > 0]
                toxic += bad.T @ bad
        yield pa.RecordBatch.from_arrays([pa.array(often[paired(both, toxic, all_pos, every)], pa.int64())], ["bucket"])

    return find


def _ratio(pos: np.ndarray, n: np.ndarray, all_pos: float, every: float) -> np.ndarray:
    """Log-likelihood ratios of presence and label: pos of n texts with it are toxic, all_pos of every text."""
    d = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    neg, p0, n0 = n - pos, all_pos - pos, every - all_pos - (n - pos)
    return 2 * (d(pos) + d(neg) + d(p0) + d(n0) - d(n) - d(every - n) + d(every) - d(np.float64(all_pos)) - d(np.float64(every - all_pos)))


def paired(both: np.ndarray, toxic: np.ndarray, all_pos: float, every: float) -> list[int]:
    """Places of terms in telling pairs, the best pairs first; the tables count texts, and toxic ones, with two terms each."""
    own = _ratio(np.diag(toxic).astype(float), np.diag(both).astype(float), all_pos, every)
    found = []
    for i in range(len(both)):  # by rows, so that no other table of all pairs is held
        gain = _ratio(toxic[i, i + 1 :].astype(float), both[i, i + 1 :].astype(float), all_pos, every) - np.maximum(own[i], own[i + 1 :])
        found += [(-gain[j], i, i + 1 + j) for j in np.flatnonzero((both[i, i + 1 :] >= 5) & (gain >= PAIR_EVIDENCE)).tolist()]
    return list(dict.fromkeys(x for _, i, j in sorted(found) for x in (i, j)))[:PAIR_FEATURES]


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, held_out, score, predicted) per row of ``docs``.

    A null or empty text has no term and gets the score of the bias alone. Repeated rows
    and null ids (held out) are scored row by row. Whole texts count, very long ones in
    pieces of whole texts; columns other than id and text are not read. An empty table
    gives no rows.
    """
    spread = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spread.value
        for batch in batches:
            for first, end, rows, bucket in _terms(batch.column(2)):
                keep = np.isin(bucket, model.known)
                raw = model.raw(rows[keep], model.index(bucket[keep]), end - first)
                value = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
                some = [batch.column(i).slice(first, end - first) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*some, pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, machine: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; columns and kinds stay."""
    spread = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spread.value
        for batch in batches:
            clean = [np.zeros(0, bool)]
            for first, end, rows, bucket in _terms(batch.column(at)):
                known = np.isin(bucket, model.known)
                clean.append(model.raw(rows[known], model.index(bucket[known]), end - first) < 0)
            yield batch.filter(pa.array(np.concatenate(clean)))

    return docs.mapInArrow(keep, docs.schema)
