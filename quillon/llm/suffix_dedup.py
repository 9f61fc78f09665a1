"""Removal of byte strings of ``LENGTH`` bytes or more that occur elsewhere, by a distributed suffix array.

1. Every string of ``LENGTH`` bytes has an anchor, the gram of ``GRAM`` bytes in it with the smallest hash (the leftmost
   of equal ones). Equal strings have their anchor at the same offset, so that a string can repeat only where the gram
   of its anchor does. A text becomes the sequence of its anchors' grams; suffixes whose first gram is the only one of
   its kind have no neighbour and are put aside. Texts that are equal as a whole enter once, with their number.
2. The suffix array of these sequences is built by the difference-cover algorithm (``suffix_ranks``): the triples at two
   of three places are sorted and named, the sequence of names is ranked by recursion, and the suffixes at the remaining
   places are merged in by their first symbol and the rank behind it.
3. Suffixes that begin with the same gram are neighbours in that order. They are taken in cells of up to ``CELL`` of
   them, and the strings that each anchor stands for are compared (by 128-bit fingerprints). For a gram that fills more
   than one cell, each cell passes on its distinct strings, which are counted once more over all its cells.
4. Bytes that a repeated string covers are removed.

The suffix array is one of anchors and not of all bytes, which would be sorted some 170 times as often. A null text is
an empty one; texts under ``LENGTH`` bytes stay whole; texts of any length are taken whole. Rows that repeat are copies
of each other. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ordering import dense_ranks, numbered, running_sums
from quillon.store import Stages

LENGTH, GRAM = 400, 64
#: Anchors compared together; more of one gram are compared in several cells.
CELL = 4096
#: A sequence with so many symbols at most, over all texts, is ranked in one task; longer ones by one more recursion.
BASE = 250_000
#: Bytes hashed together, and windows compared together.
BLOCK, WINDOWS = 1 << 20, 1_000_000

_MULTIPLY = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Rolling:
    """Polynomial hashes of all strings of one length, over codes drawn for each byte, modulo 2**64."""

    def __init__(self, k: int, seed: int, room: int):
        self.k = k
        self.codes = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
        base = _MULTIPLY[seed % 2] | 1
        self.up, self.down = _powers(base, room), _powers(pow(base, -1, 2**64), room)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        """One hash for each start; ``raw`` has at most ``room`` bytes."""
        n = len(raw) - self.k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.codes[raw] * self.down[: len(raw)], out=sums[1:])
        out = (sums[self.k :] - sums[:n]) * self.up[:n]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


_ROLLING: dict[tuple[int, int], _Rolling] = {}


def _rolling(k: int, seed: int, room: int) -> _Rolling:
    found = _ROLLING.get((k, seed))
    if found is None or len(found.up) < room:
        found = _ROLLING[k, seed] = _Rolling(k, seed, room)
    return found


def anchors_of(raw: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """Text, first and last start it stands for, and gram hash of each anchor; ``bounds``: where texts begin, and the end."""
    w = length - gram + 1
    found = []
    for at in range(0, len(raw), BLOCK):
        block = raw[at : at + BLOCK + length - 1]
        n = len(block) - length + 1
        if n <= 0:
            break
        grams = _rolling(gram, 0, BLOCK + length)(block)
        keys = (grams & np.uint64(_MASK ^ 0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        wide = np.full(-(-len(keys) // w) * w, _MASK, np.uint64)
        wide[: len(keys)] = keys
        wide = wide.reshape(-1, w)
        head = np.minimum.accumulate(wide, axis=1).ravel()
        tail = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(tail[:n], head[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
        starts = np.arange(at, at + n)
        text = np.searchsorted(bounds, starts, "right") - 1
        inside = starts + length <= bounds[text + 1]
        starts, text, anchor = starts[inside], text[inside], anchor[inside]
        if len(starts):
            new = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(text) != 0)])
            last = np.r_[new[1:], len(starts)] - 1
            found.append((text[new], starts[new], starts[last], anchor[new] + at, grams[anchor[new]]))
    if not found:
        return [np.zeros(0, np.int64)] * 4
    text, lo, hi, anchor, name = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(text) != 0)])
    hi = hi[np.r_[new[1:], len(lo)] - 1]
    return [text[new], lo[new] - bounds[text[new]], hi - bounds[text[new]], (name[new] >> np.uint64(1)).astype(np.int64) + 1]


def _cutter(length: int, gram: int):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes = pa.compute.binary_length(rows.column(1)).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(sizes):
                end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 2 * BLOCK, "right")))
                bounds = np.r_[0, np.cumsum(sizes[at:end])]
                raw = np.frombuffer(b"".join(rows.column(1).slice(at, end - at).to_pylist()), np.uint8)
                text, lo, hi, name = anchors_of(raw, bounds, length, gram)
                offsets = pa.array(np.searchsorted(text, np.arange(end - at + 1)).astype("i4"))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (lo, hi, name)]
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(at, end - at), pa.array(sizes[at:end].astype("i8")), *lists], ["sha", "n_bytes", "lo", "hi", "name"])
                at = end

    return cut


# -- suffix array --------------------------------------------------------------


def _rank_here(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ranks of all suffixes of a table of bounded size, by doubling."""
    pdf = pdf.sort_values(["t", "r", "i"], ignore_index=True)
    n = len(pdf)
    last = np.r_[(pdf[["t", "r"]].shift(-1) != pdf[["t", "r"]]).any(axis=1).to_numpy()[: n - 1], True][:n]
    ends = np.flatnonzero(last)
    end = ends[np.searchsorted(ends, np.arange(n))]
    rank = np.unique(pdf["sym"].to_numpy(), return_inverse=True)[1].astype(np.int64) + 1
    step, kinds = 1, 0
    while n and kinds < (kinds := int(rank.max())):
        behind = np.arange(n) + step
        second = np.where(behind <= end, rank[np.minimum(behind, n - 1)], 0)
        rank = np.unique(rank * (n + 2) + second, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    below = np.r_[0, np.cumsum(np.bincount(rank, minlength=1)[1:])] if n else np.zeros(1, np.int64)
    return pdf[["t", "r", "i"]].assign(rank=below[rank - 1] + 1)


def suffix_ranks(text: DataFrame, stages: Stages, base: int = BASE, level: int = 0) -> DataFrame:
    """t, r, i and ``rank`` (1 and the number of smaller suffixes) for the sequences (t, r) of positive symbols ``sym`` at i = 0, 1, ...

    Equal suffixes have equal ranks, and the end of a sequence comes before every symbol.
    """
    if text.count() <= base:
        return stages.keep(text.withColumn("one", F.col("t") * 0).groupBy("one").applyInPandas(_rank_here, "t long, r long, i long, rank long"), f"ranks-{level}")
    along = Window.partitionBy("t", "r").orderBy("i")

    def ahead(column: str, k: int):
        return F.coalesce(F.lead(column, k).over(along), F.lit(0).cast("long"))

    # triples at places 1 and 2 of 3, sorted and named
    seen = text.select("t", "r", "i", "sym", ahead("sym", 1).alias("s1"), ahead("sym", 2).alias("s2"))
    named = stages.keep(dense_ranks(stages.keep(seen.where("i % 3 > 0"), f"triples-{level}"), ["sym", "s1", "s2"], stages, f"triples-{level}", "name"), f"named-{level}")
    names = named.agg(F.count("*"), F.max("name")).first()
    if names[0] == (names[1] or 0):
        ranks = named.select("t", "r", "i", F.col("name").alias("rank"))
    else:  # their names, as two sequences each, ranked by recursion
        deeper = named.select("t", F.expr("2 * r + i % 3 - 1 AS r"), F.expr("i div 3 AS i"), F.col("name").alias("sym"))
        ranks = suffix_ranks(stages.keep(deeper, f"names-{level}"), stages, base, level + 1).select("t", F.expr("r div 2 AS r"), F.expr("3 * i + r % 2 + 1 AS i"), "rank")
    # the rest is merged in
    placed = text.join(ranks, ["t", "r", "i"], "left")
    placed = placed.select("t", "r", "i", "sym", "rank", ahead("sym", 1).alias("s1"), ahead("rank", 1).alias("r1"), ahead("rank", 2).alias("r2"))
    placed = stages.keep(placed, f"placed-{level}")
    against_1 = _smaller(placed.where("i % 3 < 2"), ["sym", "r1"], stages, f"first-{level}")
    against_2 = _smaller(placed.where("i % 3 != 1"), ["sym", "s1", "r2"], stages, f"second-{level}")
    kinds = {k: placed.where(f"i % 3 = {k}") for k in range(3)}
    third = kinds[0].join(against_1.withColumnsRenamed({"rest": "a", "sampled": "b"}), ["sym", "r1"]).join(against_2.withColumnsRenamed({"rest": "c", "sampled": "d"}), ["sym", "s1", "r2"])
    out = third.selectExpr("t", "r", "i", "1 + a + b + d AS rank")
    out = out.unionByName(kinds[1].join(against_1, ["sym", "r1"]).selectExpr("t", "r", "i", "rank + rest AS rank"))
    out = out.unionByName(kinds[2].join(against_2, ["sym", "s1", "r2"]).selectExpr("t", "r", "i", "rank + rest AS rank"))
    out = stages.keep(out, f"ranks-{level}")
    stages.drop(*[f"{x}-{level}" for x in ("named", "names", "placed")])
    return out


def _smaller(rows: DataFrame, keys: list[str], stages: Stages, name: str) -> DataFrame:
    """For each key, how many suffixes at a third place (``rest``) and at a sampled one (``sampled``) have a smaller key."""
    counted = rows.groupBy(*keys).agg(F.count_if(F.expr("i % 3 = 0")).alias("n_rest"), F.count_if(F.expr("i % 3 > 0")).alias("n_sampled"))
    sums = running_sums(counted, keys, {"n_rest": "rest", "n_sampled": "sampled"}, stages, name)
    return sums.select(*keys, (F.col("rest") - F.col("n_rest")).alias("rest"), (F.col("sampled") - F.col("n_sampled")).alias("sampled"))


# -- comparison ----------------------------------------------------------------


def _contexts(length: int):
    """From texts with their anchors: the bytes of all strings that an anchor stands for."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[list] = [[] for _ in range(6)]
            for t, raw, found in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
                for a in found:
                    for x, v in zip(out, (a["name"], a["cell"], a["open"], t, a["lo"], raw[a["lo"] : a["hi"] + length]), strict=True):
                        x.append(v)
                if len(out[0]) > 20_000:
                    yield _context_batch(out)
                    out = [[] for _ in range(6)]
            yield _context_batch(out)

    return read


def _context_batch(out: list[list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["name", "cell", "open", "t", "lo", "bytes"])


FOUND = "kind string, t long, lo long, hi long, h1 long, h2 long, n long"


def _compare(length: int):
    """From contexts, the ones of a cell together: ``cover`` rows (bytes lo to hi of t), and of open cells the distinct strings as ``open`` rows."""

    def judge(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        name, cell, t, lo = (rows.column(c).to_numpy() for c in ("name", "cell", "t", "lo"))
        group = np.cumsum(np.r_[0, (np.diff(name) != 0) | (np.diff(cell) != 0)])
        sizes = pa.compute.binary_length(rows.column("bytes")).to_numpy()
        raw = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8)
        ends = np.cumsum(sizes)
        n = sizes - length + 1
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hashes = []
        for seed in (1, 2):
            roll, whole = _rolling(length, seed, BLOCK + length), np.zeros(max(len(raw) - length + 1, 0), np.uint64)
            for at in range(0, len(whole), BLOCK):
                whole[at : at + BLOCK] = roll(raw[at : at + BLOCK + length - 1])
            hashes.append(whole[(ends - sizes)[row] + place])
        h1, h2 = hashes
        of = group[row]
        order = np.lexsort((h2, h1, of))
        a, b, c = h1[order], h2[order], of[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (c[1:] == c[:-1])
        hit = np.zeros(len(row), bool)
        hit[order] = np.r_[same, False] | np.r_[False, same] if len(row) else False
        # runs of repeated strings of a context
        at = np.flatnonzero(hit)
        if len(at):
            new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(row[at]) != 0)])
            last = np.r_[new[1:], len(at)] - 1
            first = at[new]
            yield _found("cover", t[row[first]], lo[row[first]] + place[first], lo[row[first]] + place[at[last]] + length)
        heads = order[np.r_[True, ~same]] if len(row) else order
        heads = heads[rows.column("open").to_numpy(zero_copy_only=False)[row[heads]]]
        if len(heads):
            start = lo[row[heads]] + place[heads]
            yield _found("open", t[row[heads]], start, start + length, h1[heads].view("i8"), h2[heads].view("i8"), 1 + hit[heads].astype("i8"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for rows in batches:
            name, cell = (rows.column(k).to_numpy() for k in (0, 1))
            bounds = np.r_[0, np.flatnonzero((np.diff(name) != 0) | (np.diff(cell) != 0)) + 1, len(name)]
            windows = np.r_[0, np.cumsum(pa.compute.binary_length(rows.column(5)).to_numpy() - length + 1)]
            at = 0
            for b in bounds[:-1].tolist() if len(name) else ():
                begins = not held or b > 0 or (name[0], cell[0]) != (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py())
                if begins and weight + windows[b] - windows[at] > WINDOWS:
                    if b > at:
                        held.append(rows.slice(at, b - at))
                    yield from judge(held)
                    held, weight, at = [], 0, b
            if len(name) > at:
                held.append(rows.slice(at))
                weight += int(windows[-1] - windows[at])
        if held:
            yield from judge(held)

    return compare


def _found(kind: str, t: np.ndarray, lo: np.ndarray, hi: np.ndarray, h1=None, h2=None, n=None) -> pa.RecordBatch:
    k = len(t)
    columns = [pa.array([kind] * k, pa.string()), *[pa.array(x) if x is not None else pa.nulls(k, pa.int64()) for x in (t, lo, hi, h1, h2, n)]]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FOUND.split(", ")])


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts with covered stretches: bytes and runs removed, digest of the rest."""
    for rows in batches:
        out: list[tuple] = []
        for sha, raw, covers in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
            digest, at, removed, spans = hashlib.sha256(), 0, 0, 0
            end = -1
            for c in sorted((c["lo"], c["hi"]) for c in covers):
                if c[0] > end:
                    digest.update(raw[at : c[0]])
                    spans += 1
                    at = end = c[0]
                if c[1] > end:
                    removed += c[1] - end
                    at = end = c[1]
            digest.update(raw[at:])
            out.append((sha, removed, spans, digest.hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(("sha", "n_removed", "n_spans", "kept_sha256"), x, strict=True)) for x in out], pa.schema([("sha", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def repeated_stretches(docs: DataFrame, stages: Stages, length: int = LENGTH, gram: int = GRAM, cell: int = CELL, base: int = BASE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts: sha, n_bytes, copies; the texts that share an anchor: sha, t, raw; stretches of them that repeat: t, lo, hi).

    A stretch may overlap others. Texts with copies are covered whole, whatever the stretches say.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    read = docs.select(F.sha2(text, 256).alias("sha"), text.alias("raw"))
    cut = read.where(F.octet_length("raw") >= length).mapInArrow(_cutter(length, gram), "sha string, n_bytes long, lo array<long>, hi array<long>, name array<long>")
    once = cut.groupBy("sha").agg(F.first("n_bytes").alias("n_bytes"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("lo", "hi", "name")])
    texts = stages.keep(once.withColumn("t", F.monotonically_increasing_id()), "texts")
    each = texts.select("t", F.posexplode(F.arrays_zip("lo", "hi", "name")).alias("at", "a")).select("t", F.col("at").cast("long").alias("at"), "a.*")
    many = stages.keep(each.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "many")  # written, so that Spark can split the join
    kept = stages.keep(each.join(many, "name"), "anchors")
    # sequences are broken where an anchor is left out
    along = Window.partitionBy("t").orderBy("at")
    runs = kept.select("t", "at", "name", F.sum(F.coalesce(F.col("at") - F.lag("at").over(along) - 1, F.col("at"))).over(along).alias("r"))
    text_of = runs.select("t", "r", (F.row_number().over(Window.partitionBy("t", "r").orderBy("at")) - 1).cast("long").alias("i"), F.col("name").alias("sym"), "at")
    text_of = stages.keep(text_of, "symbols")
    ranks = suffix_ranks(text_of.select("t", "r", "i", "sym"), stages, base)
    placed = kept.join(text_of.join(ranks, ["t", "r", "i"]).select("t", "at", "rank"), ["t", "at"])
    crowded = numbered(placed.where(F.col("n") > cell), ["rank"], stages, "crowded", ["name"], "of")
    cells = placed.where(F.col("n") <= cell).withColumn("cell", F.lit(0).cast("long")).unionByName(crowded.withColumn("cell", F.expr(f"of div {cell}L")).drop("of"))
    wanted = cells.groupBy("t").agg(F.collect_list(F.struct("name", "cell", (F.col("n") > cell).alias("open"), "lo", "hi")).alias("found"))
    wanted = stages.keep(texts.join(wanted, "t").select("sha", "t", "found"), "wanted")
    # one row of each text
    first = read.select("sha", "raw", F.monotonically_increasing_id().alias("at")).join(wanted.select("sha").hint("shuffle_hash"), "sha", "left_semi")
    met = stages.keep(first.dropDuplicates(["sha"]).drop("at").join(wanted, "sha"), "met")
    contexts = met.select("t", "raw", "found").mapInArrow(_contexts(length), "name long, cell long, open boolean, t long, lo long, bytes binary")
    dealt = contexts.repartition("name", "cell").sortWithinPartitions("name", "cell")
    found = stages.keep(dealt.mapInArrow(_compare(length), FOUND), "found", "kind")
    opened = found.where("kind = 'open'").select("t", "lo", "hi", "h1", "h2", "n")
    again = opened.groupBy("h1", "h2").agg(F.sum("n").alias("all")).where("all > 1").select("h1", "h2")
    covers = found.where("kind = 'cover'").select("t", "lo", "hi").unionByName(opened.where("n = 1").join(again, ["h1", "h2"]).select("t", "lo", "hi"))
    return texts.select("sha", "n_bytes", "copies"), met.select("sha", "t", "raw"), covers


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cell: int = CELL, base: int = BASE) -> DataFrame:
    """One row for each of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (op11)."""
    stages = Stages(docs.sparkSession, "suffixes")
    texts, met, covers = repeated_stretches(docs, stages, length, gram, cell, base)
    single = met.join(texts.where("copies = 1"), "sha").select("sha", "t", "raw")
    lists = covers.groupBy("t").agg(F.collect_list(F.struct("lo", "hi")).alias("covers"))
    parts = single.join(lists, "t").select("sha", "raw", "covers").mapInArrow(_kept, "sha string, n_removed long, n_spans long, kept_sha256 string")
    none = hashlib.sha256(b"").hexdigest()
    whole = texts.where("copies > 1").select("sha", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(none).alias("kept_sha256"))
    changed = stages.keep(parts.unionByName(whole), "changed")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    zero = F.lit(0).cast("long")
    return rows.join(changed, "sha", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )


ORACLE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), windows AS (
  SELECT r, p, md5(substr(h, 2 * p + 1, {2 * LENGTH})) AS m FROM (SELECT r, h, unnest(range(0, n - {LENGTH - 1})) AS p FROM docs)
), hits AS (
  SELECT r, p FROM windows WHERE m IN (SELECT m FROM windows GROUP BY m HAVING count(*) > 1)
), marked AS (
  SELECT r, p, sum(CASE WHEN p > before + {LENGTH} OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS g
  FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM hits)
), spans AS (
  SELECT r, min(p) AS lo, max(p) + {LENGTH} AS hi, lag(max(p) + {LENGTH}, 1, 0::BIGINT) OVER (PARTITION BY r ORDER BY min(p)) AS free FROM marked GROUP BY r, g
), sums AS (
  SELECT d.r, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * free + 1, 2 * (lo - free)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS rest
  FROM spans s JOIN docs d ON d.r = s.r GROUP BY d.r
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM docs LEFT JOIN sums USING (r)
"""
