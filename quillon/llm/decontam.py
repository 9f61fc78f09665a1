"""Benchmark decontamination by template canonicalisation.

Texts become sequences of canonical tokens: a number becomes NUM, a number with a unit
QTY, a capitalised word (or run of them) inside a sentence NAME; other words stay, in
lower case. Windows of ``WINDOW`` tokens are hashed; windows of documents that a Bloom filter
of the benchmark's windows (``BLOOM_BITS``, a fixed size) lets pass meet them in a hash join.
Along one alignment of item and document the values behind the placeholders must agree both
ways: a value of the item stands for one value in the document throughout, and a value of the
document for one of the item, up to ``MISFIT`` of the values. So a question with other numbers and names is found, while a text that merely shares
the phrase is not joined into it. A document is contaminated if ``COVER`` of an item's windows
are found in it.

* A window of fewer than ``LITERAL`` plain words is hashed with its values and so matches its
  exact copy only. It counts with the others, but an item's other windows also do by themselves.
* A capitalised word that opens a sentence may be a name or not: windows with such words are
  hashed in both forms.
* An item of ``LITERAL`` to ``WINDOW`` - 1 tokens is one window of its own length. One of fewer
  tokens is no question but a phrase, and matches a text that equals it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.textvec import _A, NOT_WORD, Words, mix, pieces
from quillon.store import Stages

WINDOW = 8
LITERAL = 4
COVER = 0.5
MISFIT = 0.25
BLOOM_BITS = 1 << 22
# fixed values: units that may follow a number
UNITS = (
    "% cent cents celsius cm day days degrees dollar dollars eur euro euros fahrenheit feet foot ft g gb gram grams hour hours hr hrs inch"
    " inches kb kg kilometers km km/h kmh l lb lbs liter liters m mb meter meters mg mi mile miles min minute minutes ml mm month months mph"
    " percent pound pounds sec second seconds ton tons usd week weeks yard yards year years"
).split()

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.isin(np.arange(256), list(b".!?\n\r:;"))
_POINT = np.isin(np.arange(256), list(b".,"))
_UNIT_HASH = None


def _unit_hashes() -> np.ndarray:
    global _UNIT_HASH
    if _UNIT_HASH is None:
        words = Words(*next(pieces(pa.array(UNITS)))[2:], NOT_WORD)
        _UNIT_HASH = np.unique(words.hashes)
    return _UNIT_HASH


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, canonical hash, value hash, kind, opener) of each token; kind 0 word, 1 NUM, 2 QTY, 3 NAME.

    An opener is a plain word with a capital at the head of a sentence.
    """
    words = Words(data, offsets, NOT_WORD)
    s, e, row = words.starts, words.ends, words.row
    if not len(s):
        return row, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool)
    h = words.hashes
    digits = np.r_[0, np.cumsum(_DIGIT[data])]
    n_digits = digits[e] - digits[s]
    kind = np.zeros(len(s), np.int8)
    kind[n_digits == e - s] = 1
    kind[(n_digits < e - s) & _DIGIT[data[s]]] = 2
    stops = np.r_[0, np.cumsum(_STOP[data])]
    first = np.r_[True, row[1:] != row[:-1]]
    after_stop = np.r_[True, stops[s[1:]] > stops[e[:-1]]] | first
    # capitals of two bytes in UTF-8: U+00C0 to U+00DE
    second = data[np.minimum(s + 1, len(data) - 1)]
    capital = _UPPER[data[s]] | ((data[s] == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    opener = (kind == 0) & capital & after_stop
    kind[(kind == 0) & capital & ~after_stop] = 3
    same = ~first
    before = np.r_[0, kind[:-1]]
    gap = np.r_[0, s[1:] - e[:-1]]
    unit = same & (kind == 0) & ((before == 1) | (before == 2)) & np.isin(h, _unit_hashes())
    decimal = same & (kind == 1) & (before == 1) & (gap == 1) & _POINT[data[np.maximum(s - 1, 0)]]
    run = same & (kind == 3) & (before == 3)
    kind[np.flatnonzero(unit) - 1] = 2
    joined = unit | decimal | run
    head = np.flatnonzero(~joined)
    last = np.r_[head[1:], len(s)] - 1
    k = kind[head]
    value = words.span_hash(s[head], e[last])
    marks = mix(np.arange(4, dtype=np.uint64), 41)
    return row[head], np.where(k > 0, marks[k], h[head]), value, k, opener[head]


def _spans(at: np.ndarray, end: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the token spans at..end, of k tokens at most; spans of k tokens as ``windows`` has them."""
    total = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            live = at + i < end
            step = total * _A + mix(hashes[np.minimum(at + i, max(len(hashes) - 1, 0))], i + 1)
            total = np.where(live, step, total)
        return mix(mix(total, k) ^ np.where(end - at < k, np.uint64(99), np.uint64(0)), 0) if len(at) else total


def _windows(column: pa.Array, lengths: list[int] | None) -> Iterator[tuple]:
    """By piece: first row, and of each window row, place in the text, hash, whether it is low in words,
    size, first token, end; then value hashes, and two lists of kinds (one with openers as names) and which of them holds.

    ``lengths`` are the sizes of short windows in documents; None takes each short text as an item.
    """
    for first, _, data, offsets in pieces(column):
        row, h, value, kind, opener = canonical(data, offsets)
        named = np.where(opener, np.int8(3), kind)
        other = np.where(opener, mix(np.arange(4, dtype=np.uint64), 41)[3], h)
        words = np.r_[0, np.cumsum(kind == 0)]
        rest = np.r_[0, np.cumsum(named == 0)]
        head = np.searchsorted(row, row)
        size = np.searchsorted(row, row, "right") - head  # tokens of the text
        start = np.arange(len(row))
        out = []
        short = range(LITERAL, WINDOW) if lengths is None else lengths
        for k in [WINDOW, *short]:
            if k == WINDOW:
                whole = (size < LITERAL) if lengths is None else (size < WINDOW)
                at = np.flatnonzero((start + k <= head + size) | (whole & (start == head)))
            else:
                at = np.flatnonzero((size == k) & (start == head) if lengths is None else start + k <= head + size)
            end = np.minimum(at + k, head[at] + size[at])
            plain, fixed = words[end] - words[at], rest[end] - rest[at]
            low = (plain < LITERAL) & (plain < end - at)
            hashes = np.where(low, np.uint64(0), _spans(at, end, h, k))
            hashes[low] = mix(_spans(at[low], end[low], value, k), 7)
            both = np.flatnonzero((fixed < plain) & (fixed >= LITERAL))
            out.append((at, end, hashes, low, np.zeros(len(at), bool)))
            out.append((at[both], end[both], _spans(at[both], end[both], other, k), low[both], np.ones(len(both), bool)))
        at, end, hashes, low, form = (np.concatenate(x) for x in zip(*out, strict=True))
        yield first, row[at], at - head[at], hashes, low, size[at], at, end, value, (kind, named), form


def _slots(at: int, end: int, value: np.ndarray, kind: np.ndarray) -> list[int]:
    return [int(v) for v, k in zip(value[at:end].view(np.int64), kind[at:end], strict=True) if k]


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(BLOOM_BITS - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


_ITEM = "item_id long, place long, h long, low boolean, size int, slots array<long>, bit1 int, bit2 int"


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, row, place, hashes, low, size, at, end, value, kinds, form in _windows(batch.column(1), None):
            one, two = _bits(hashes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[first + r] for r in row], pa.int64()), pa.array(place, pa.int64()), pa.array(hashes.view(np.int64)),
                    pa.array(low), pa.array(size, pa.int32()),
                    pa.array([_slots(a, b, value, kinds[f]) for a, b, f in zip(at, end, form.astype(int), strict=True)], pa.list_(pa.int64())),
                    pa.array(one, pa.int32()), pa.array(two, pa.int32()),
                ],
                ["item_id", "place", "h", "low", "size", "slots", "bit1", "bit2"],
            )


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cover: float = COVER) -> DataFrame:
    """Rows (doc_id, text_hash, item_id, cover): the item that each contaminated text covers most.

    A text is named by its id and xxhash64, so that null and repeated ids are told apart by
    their texts, and repeated rows give one row. Ties go to the smaller item_id. Items with a
    null id or text, and empty texts, match nothing; an item of under LITERAL tokens matches
    only a text that equals it. Very long texts are searched whole. An empty table on either
    side gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "decontam")
    items = benchmark.select(F.col(item_col).cast("long"), F.col(item_text)).dropna().mapInArrow(_item_windows, _ITEM)
    items = stages.keep(items, "items")
    lengths = sorted(r["size"] for r in items.where(F.col("size").between(LITERAL, WINDOW - 1)).select("size").distinct().collect())
    marks = items.select(F.explode(F.array("bit1", "bit2")).alias("b")).distinct().toPandas()["b"].to_numpy(np.int64)  # BLOOM_BITS rows at most
    flags = np.zeros(BLOOM_BITS, bool)
    flags[marks] = True
    spread = spark.sparkContext.broadcast(np.packbits(flags, bitorder="little"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = spread.value
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, row, place, hashes, _, _, at, end, value, kinds, form in _windows(batch.column(2), lengths):
                hit = np.ones(len(hashes), bool)
                for b in _bits(hashes):
                    hit &= ((bloom[b >> 3] >> (b & 7)) & 1).astype(bool)
                i = np.flatnonzero(hit)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[first + r] for r in row[i]], pa.int64()), pa.array([keys[first + r] for r in row[i]], pa.int64()),
                        pa.array(place[i], pa.int64()), pa.array(hashes[i].view(np.int64)),
                        pa.array([_slots(at[j], end[j], value, kinds[int(form[j])]) for j in i], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_hash", "at", "h", "found"],
                )

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    found = found.mapInArrow(look, "doc_id long, text_hash long, at long, h long, found array<long>")
    places = [F.countDistinct("place"), F.countDistinct(F.when(~F.col("low"), F.col("place")))]
    total = items.groupBy("item_id").agg(places[0].alias("all"), places[1].alias("most"))
    met = stages.keep(found.join(items.drop("bit1", "bit2", "size"), "h").withColumn("shift", F.col("at") - F.col("place")), "met")
    line = ["doc_id", "text_hash", "item_id", "shift"]
    pairs = met.select(*line, "h", F.explode_outer(F.arrays_zip("slots", "found")).alias("p"))
    # per value of the item (and of the document): whether it stands for one value only
    pairs = pairs.select(*line, "p.slots", "p.found").distinct()
    fits = None
    for own, other in (("slots", "found"), ("found", "slots")):
        one = pairs.groupBy(*line, own).agg(F.min(other).alias("low"), F.max(other).alias("high"))
        one = one.groupBy(*line).agg(F.count(F.when(F.col("low") != F.col("high"), 1)).alias("torn"), F.count(own).alias("values"))
        one = one.where(F.col("torn") <= MISFIT * F.col("values")).select(*line)
        fits = one if fits is None else fits.intersect(one)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in line]
    counted = met.select(*line, "place", "low").distinct().alias("a").join(fits.alias("b"), same, "left_semi")
    best = counted.groupBy("doc_id", "text_hash", "item_id").agg(places[0].alias("n"), places[1].alias("m")).join(total, "item_id")
    part = F.when(F.col("most") > 0, F.col("m") / F.col("most")).otherwise(0.0)
    best = best.withColumn("cover", F.greatest(F.col("n") / F.col("all"), part)).where(F.col("cover") >= cover)
    return best.groupBy("doc_id", "text_hash").agg(F.max(F.struct("cover", (-F.col("item_id")).alias("item"))).alias("b")).select(
        "doc_id", "text_hash", (-F.col("b.item")).alias("item_id"), F.col("b.cover").alias("cover")
    )


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, contaminated, item_id, cover) per row of ``docs``; item and cover are null if it is clean."""
    hits = contaminated(docs, benchmark, id_col, text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    same = own["doc_id"].eqNullSafe(hits["doc_id"]) & (own["text_hash"] == hits["text_hash"])
    return own.join(hits, same, "left").select(own["doc_id"], hits["item_id"].isNotNull().alias("contaminated"), hits["item_id"], hits["cover"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows; null and empty texts stay, and all columns whatever their names.

    Repeated rows go or stay together; an empty ``benchmark`` takes nothing.
    """
    hits = contaminated(docs, benchmark, id_col, text_col).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}).select("_id", "_hash")
    same = docs[id_col].cast("long").eqNullSafe(hits["_id"]) & (F.xxhash64(docs[text_col]) == hits["_hash"])
    return docs.join(hits, same, "left_anti")
