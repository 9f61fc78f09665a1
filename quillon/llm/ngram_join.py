"""N-gram Jaccard join by a token-group matrix.

A document's set holds the 64-bit hashes of its distinct 3-word shingles (words are
split at ASCII white space, A-Z lower-cased); with one or two words the whole sequence
is the one member. Two sets link when 100 * |A n B| >= 90 * |A u B|.

Steps
  1. One pass counts shingles in a table of counters (16 a document, ``MOST_BUCKETS`` at most), which gives one
     global order from rare to common.
  2. A second pass writes per document: set size, a 128-bit key of the set, the n - ceil(0.9 n) + 1 rarest members
     (two linked sets share one of these, named by 48 of their 64 bits) and a bitmap of the set with four bits or more
     a member. Equal sets are one class.
  3. Members that occur in one class only are dropped, by one shuffle of the rare members. A member whose counter
     says that it may be frequent is kept without this test, so that no task holds the rows of a frequent member.
     Classes that share a rare member are candidates. They are partitioned into groups of similar sets: the smallest
     shingle hash names a family, and a family of more than ``GROUP`` classes or ``GROUP_MEMBERS`` members is split by
     hash into as many groups as it needs.
  4. Bitmaps bound the overlap of two sets from above: a member on a bit that is empty in the other set is not in it.
     Inside a group, and inside groups by the commonest rare member, sets without any set within reach are put aside.
     Texts of the rest are read; the groups are opened: exact links inside them. The centres of the resulting parts of
     split families are grouped and linked again, and then all centres by the commonest of their rare members.
  5. The token-group matrix holds, for each rare member, the groups having it, and is needed only for members that
     occur in two or more components. A class outside a member's largest component queries the groups of that member.
     The union of a group's sets is kept as a bitmap, which bounds the overlap of the query with any of them; in a group
     that may reach ceil(0.9 n), the bitmaps of its sets are asked too. What still may link is opened, that is read and
     compared exactly.
  6. Connected components over the links.

A pair of different components has at least one side outside the member's largest
component, so that no link between components is lost; links inside a component are not
enumerated. No step emits pairs of documents, other than those of a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.textvec import SPACES, Words, distinct_by_row, mix, pieces, windows
from quillon.operators.components import connected_components
from quillon.store import Stages

MOST_BUCKETS = 1 << 24
SLICES = 64
#: A rare member that may have more rows than this, and than ``HOT_SHARE`` times the mean counter, is kept without a count.
HOT_ROWS = 100_000
HOT_SHARE = 20
GROUP = 1024
GROUP_MEMBERS = 500_000
QUERIES = 512
BITS = 4
MOST_FETCH_BITS = 1 << 28
THRESHOLD = 90  # per cent


def _sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each member, members) with rows counted from the first."""
    for first, end, data, offsets in pieces(column):
        words = Words(data, offsets, SPACES)
        at, shingles = windows(words.row, words.hashes, shingle)
        yield (first, end, *distinct_by_row(words.row[at], shingles))


def _least(n: np.ndarray | int, threshold: int) -> np.ndarray | int:
    """Members that a set of n shares at least with a set that it links to."""
    return (threshold * n + 99) // 100


def _slot(members: np.ndarray, buckets: int) -> np.ndarray:
    return (members >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def _counter(shingle: int, buckets: int):
    """Counters of a task, as SLICES compressed runs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.uint32)
        waiting, n = [], 0

        def add() -> None:
            nonlocal waiting, n
            if waiting:
                total[:] += np.bincount(np.concatenate(waiting), minlength=buckets).astype(np.uint32)
            waiting, n = [], 0

        for batch in batches:
            for _, _, _, members in _sets(batch.column(0), shingle):
                waiting.append(_slot(members, buckets).astype(np.int32))
                n += len(members)
                if n > min(buckets, 1 << 22):
                    add()
        add()
        yield _packed(dict(enumerate(total.reshape(SLICES, -1))))

    return count


def _packed(runs: dict[int, np.ndarray]) -> pa.RecordBatch:
    data = [pa.compress(x.astype(np.uint32).tobytes(), codec="zstd", asbytes=True) for x in runs.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(runs), pa.int32()), pa.array(data, pa.binary())], ["slice", "counts"])


def _unpacked(data: bytes, buckets: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=buckets // SLICES * 4, codec="zstd", asbytes=True), np.uint32)


def _frequencies(source: DataFrame, shingle: int) -> np.ndarray:
    """Occurrences by bucket, over all documents: 16 buckets a document, ``MOST_BUCKETS`` at most."""
    buckets = min(MOST_BUCKETS, max(1 << 16, 1 << (16 * source.count()).bit_length()))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                run = _unpacked(data, buckets)
                total[i] = total[i] + run if i in total else run
        yield _packed(total)

    form = "slice int, counts binary"
    rows = source.select("text").mapInArrow(_counter(shingle, buckets), form).repartition(SLICES, "slice").mapInArrow(add_up, form).collect()
    table = np.zeros((SLICES, buckets // SLICES), np.uint32)
    for r in rows:
        table[r["slice"]] += _unpacked(r["counts"], buckets)
    return table.ravel()


def _key(members: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """128-bit keys of sets given as sorted runs."""
    if not len(starts):
        return []
    with np.errstate(over="ignore"):
        two = np.stack([np.add.reduceat(mix(members, 11), starts), np.add.reduceat(mix(members, 12), starts)], 1)
    raw = two.tobytes()
    return [raw[16 * i : 16 * i + 16] for i in range(len(starts))]


_SIGNATURE = "doc_id long, n long, k binary, family long, rare array<long>, hot array<long>, bits binary"


def _bit_lengths(n: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set of n: a power of two, BITS n at least."""
    return np.where(n > 0, 1 << np.maximum(6, np.ceil(np.log2(np.maximum(BITS * n, 1)))).astype(np.int64), 0)


def _bitmaps(row: np.ndarray, members: np.ndarray, n: np.ndarray) -> pa.Array:
    lengths = _bit_lengths(n)
    offsets = np.r_[0, np.cumsum(lengths)]
    flags = np.zeros(offsets[-1], np.uint8)
    flags[offsets[row] + (members & (lengths[row] - 1).astype(np.uint64)).astype(np.int64)] = 1
    packed = np.packbits(flags, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((offsets // 8).astype(np.int32)), pa.py_buffer(packed)])


def _signer(shingle: int, threshold: int, frequency, hot_rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequency.value
        hot_from = max(hot_rows, int(HOT_SHARE * common.mean()))
        for batch in batches:
            ids = batch.column(0)
            for first, end, row, members in _sets(batch.column(1), shingle):
                n = np.bincount(row, minlength=end - first)
                full = np.flatnonzero(n)
                starts = np.searchsorted(row, full)
                keys: list[bytes | None] = [None] * (end - first)
                for i, k in zip(full.tolist(), _key(members, starts), strict=True):
                    keys[i] = k
                family = np.zeros(end - first, np.uint64)
                if len(full):
                    family[full] = np.minimum.reduceat(mix(members, 13), starts)
                count = common[_slot(members, len(common))]
                order = np.lexsort((members, count, row))
                take = np.where(n > 0, n - _least(n, threshold) + 1, 0)
                rank = np.arange(len(row)) - np.repeat(starts, n[full])
                chosen = order[rank < take[row]]
                token, of, hot = (members[chosen] >> np.uint64(16)).view(np.int64), row[chosen], count[chosen] >= hot_from
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, end - first), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(family.view(np.int64)),
                        _lists(of[~hot], token[~hot], end - first), _lists(of[hot], token[hot], end - first), _bitmaps(row, members, n),
                    ],
                    ["doc_id", "n", "k", "family", "rare", "hot", "bits"],
                )

    return sign


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps in rows, of ``size`` bytes."""
    return bits if bits.shape[1] == size else np.bitwise_or.reduce(bits.reshape(len(bits), -1, size), axis=1)


def _ones(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(1, dtype=np.int64)


class _Bitmaps:
    """Bitmaps of the sets of a group, by length."""

    def __init__(self, n: list[int], bits: list[bytes]):
        self.n = np.array(n, np.int64)
        self.bits = bits
        size = np.array([len(b) for b in bits], np.int64)
        self.by = []
        for length in np.unique(size).tolist():
            at = np.flatnonzero(size == length)
            self.by.append((at, np.frombuffer(b"".join(bits[i] for i in at), np.uint8).reshape(len(at), length)))

    def near(self, n: int, bits: bytes, threshold: int, live: np.ndarray) -> np.ndarray:
        """The sets among ``live`` that a set of n with this bitmap may link to."""
        own, out = np.frombuffer(bits, np.uint8)[None], []
        for at, table in self.by:
            keep = live[at] & (100 * self.n[at] >= threshold * n) & (threshold * self.n[at] <= 100 * n)
            if keep.any():
                at, size = at[keep], min(own.shape[1], table.shape[1])
                mine, theirs = _fold(own, size), _fold(table[keep], size)
                most = np.minimum(n - _ones(mine & ~theirs), self.n[at] - _ones(theirs & ~mine))
                out.append(at[(most > 0) & (100 * most >= threshold * (n + self.n[at] - most))])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _screen(threshold: int):
    """Columns g, h, n, bits sorted by g: the h that may link to another of their group."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 1):
            h, n, bits = (table.column(i).to_pylist() for i in (1, 2, 3))
            group = _Bitmaps(n, bits)
            free, kept = np.ones(len(h), bool), []
            for i in range(len(h)):
                if not free[i]:
                    continue
                free[i], waiting, part = False, [i], [i]
                while waiting:  # all that hang together by sets within reach
                    j = waiting.pop()
                    near = group.near(n[j], bits[j], threshold, free)
                    free[near] = False
                    waiting.extend(near.tolist())
                    part.extend(near.tolist())
                if len(part) > 1:
                    kept.extend(part)
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for i in kept], pa.int64())], ["h"])

    return check


class _Open:
    """Sets of a group, held as one array sorted by member."""

    def __init__(self, texts: pa.Array, names: list[int], shingle: int):
        self.names: list[int] = []
        found = []
        for first, end, row, members in _sets(texts, shingle):
            cuts = np.searchsorted(row, np.arange(end - first + 1))
            for i in range(end - first):
                self.names.append(names[first + i])
                found.append(members[cuts[i] : cuts[i + 1]])
        self.sets = found
        self.size = np.array([len(s) for s in found], np.int64)

    def index(self) -> None:
        every = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(self.sets)), self.size)
        order = np.argsort(every, kind="stable")
        self.tokens, self.owner = every[order], owner[order]

    def links(self, s: np.ndarray, threshold: int) -> np.ndarray:
        """The sets that s links to; none is compared if the union of all is too far from s."""
        low = np.searchsorted(self.tokens, s, "left")
        n = np.searchsorted(self.tokens, s, "right") - low
        if not len(s) or np.count_nonzero(n) < _least(len(s), threshold):
            return np.zeros(0, np.int64)
        low, n = low[n > 0], n[n > 0]
        at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.sets))
        return np.flatnonzero((100 * shared >= threshold * (self.size + len(s) - shared)) & (shared > 0))


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Rows of equal leading ``by`` columns, from batches sorted by them."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        lead = list(zip(*(batch.column(i).to_pylist() for i in range(by)), strict=True))
        start = 0
        for i, key in enumerate(lead):
            if key != last:
                if i > start:
                    waiting.append(batch.slice(start, i - start))
                if waiting:
                    yield pa.Table.from_batches(waiting)
                waiting, start, last = [], i, key
        waiting.append(batch.slice(start))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _inner(shingle: int, threshold: int):
    """Columns g, h, text sorted by g: each h with the centre of its part of the group."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 1):
            group = _Open(table.column(2), table.column(1).to_pylist(), shingle)
            n = len(group.sets)
            first = {name: i for i, name in reversed(list(enumerate(group.names)))}
            parent, degree = [first[name] for name in group.names], [0] * n
            if n > 1:
                group.index()
                for i in range(n):
                    near = group.links(group.sets[i], threshold)
                    degree[i] = len(near)
                    for j in near.tolist():
                        a, b = _root(parent, i), _root(parent, j)
                        if a != b:
                            parent[a] = b
            best: dict[int, int] = {}
            for i in range(n):
                r = _root(parent, i)
                if r not in best or (degree[i], group.names[i]) > (degree[best[r]], group.names[best[r]]):
                    best[r] = i
            roots = [group.names[best[_root(parent, i)]] for i in first.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.int64()), pa.array(roots, pa.int64())], ["h", "root"])

    return link


def _bound(threshold: int):
    """Columns g, part, query, h, root, n, bits sorted by the first three: (g, h, query) that may link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 2):
            g, query, h, root, n, bits = (table.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6))
            members = query.index(1) if 1 in query else len(query)
            group, of = _Bitmaps(n[:members], bits[:members]), np.array(root[:members])
            unions = [(np.bitwise_or.reduce(table, axis=0)[None], group.n[at]) for at, table in group.by]
            asked, found = np.zeros(members, bool), []
            for i in range(members, len(h)):
                if not _reaches(n[i], bits[i], unions, threshold):
                    continue
                near = group.near(n[i], bits[i], threshold, of != root[i])
                if len(near):
                    asked[near] = True
                    found.append(h[i])
            own = [h[i] for i in np.flatnonzero(asked).tolist()]
            kinds = [0] * len(own) + [1] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0]] * len(kinds), pa.int64()), pa.array(own + found, pa.int64()), pa.array(kinds, pa.int32())], ["g", "h", "query"]
            )

    return check


def _reaches(n: int, bits: bytes, unions: list, threshold: int) -> bool:
    """Whether a set of n may share enough with one of the unions (bitmap, sizes of its sets)."""
    own = np.frombuffer(bits, np.uint8)[None]
    for union, sizes in unions:
        if 100 * sizes.max() >= threshold * n and threshold * sizes.min() <= 100 * n:
            size = min(own.shape[1], union.shape[1])
            if n - _ones(_fold(own, size) & ~_fold(union, size))[0] >= _least(n, threshold):
                return True
    return False


def _outer(shingle: int, threshold: int):
    """Columns g, part, query, h, root, text sorted by the first three: links of queries to members."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 2):
            asks = np.array(table.column(2).to_pylist())
            n = int(np.count_nonzero(asks == 0))
            comps = dict(zip(table.column(3).to_pylist(), table.column(4).to_pylist(), strict=True))
            names, texts = table.column(3).to_pylist(), table.column(5)
            group = _Open(texts.slice(0, n), names[:n], shingle)
            queries = _Open(texts.slice(n), names[n:], shingle)
            group.index()
            found = set()
            for name, s in zip(queries.names, queries.sets, strict=True):
                for j in group.links(s, threshold).tolist():
                    a, b = comps[name], comps[group.names[j]]
                    if a != b:
                        found.add((min(a, b), max(a, b)))
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["src", "dst"]
            )

    return link


def _fetched(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (h, text) for ``wanted`` (h, c): the texts of the documents c, each once.

    A bitmap over hashed ids, eight bits an id and ``MOST_FETCH_BITS`` at most, spares the shuffle most other rows;
    the exact join follows.
    """
    bits = min(MOST_FETCH_BITS, max(1 << 16, 1 << (8 * wanted.count()).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(bits))
    at = slot("c") + 1  # buckets of 32768 bits count from 1, as do their values
    packed = wanted.groupBy(F.bitmap_bucket_number(at).alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("b")).collect()
    flags = np.zeros((bits >> 15, 4096), np.uint8)
    for r in packed:
        flags[r["i"] - 1] = np.frombuffer(r["b"], np.uint8)
    spread = source.sparkSession.sparkContext.broadcast(flags.ravel())

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = np.asarray(batch.column(0).fill_null(0))
            keep = ((spread.value[i >> 3] >> (i & 7)) & 1).astype(bool)
            if keep.any():
                kept = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([kept.column(1), kept.column(2)], ["doc_id", "text"])

    found = source.where("doc_id is not null").select(slot("doc_id").alias("slot"), "doc_id", "text").mapInArrow(some, "doc_id long, text string")
    named = wanted.join(found, F.col("c") == F.col("doc_id")).select("h", "text", F.xxhash64("text").alias("same"))
    return named.groupBy("h", "same").agg(F.first("text").alias("text")).drop("same")


def _grouped(nodes: DataFrame, group: int) -> DataFrame:
    """nodes(h, n, family, ...) with the group g, the family's classes, and ``split``: whether it has more groups."""
    sizes = nodes.groupBy("family").agg(F.count("*").alias("classes"), F.sum("n").alias("members"))
    count = lambda c, most: F.ceil(F.col(c) / F.lit(float(most))).cast("long")
    sizes = sizes.select("family", "classes", F.greatest(count("classes", group), count("members", GROUP_MEMBERS)).alias("parts"))
    g = F.xxhash64("family", F.pmod(F.xxhash64("h"), F.col("parts")))
    return nodes.join(sizes, "family").select(g.alias("g"), *nodes.columns, "classes", (F.col("parts") > 1).alias("split"))


def ngram_jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int = THRESHOLD,
    shingle: int = 3,
    group: int = GROUP,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) per row of ``docs``.

    component_id is the smallest id reachable by links. A null or blank text has an empty
    set and its own id. A row with a null id gets the component of its class, or null if
    no row of it has an id. Rows repeated with the same id count as equal sets; an id that
    comes with several texts is one document that links by each of them. Other columns are
    not read, so their names may clash with ours. An empty table gives no rows. A very long
    text is held whole by the task that reads it, and counts as a group of its own.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "ngram-join")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    frequency = spark.sparkContext.broadcast(_frequencies(source, shingle))

    signed = stages.keep(source.mapInArrow(_signer(shingle, threshold, frequency, hot_rows), _SIGNATURE), "signed")
    ids = stages.keep(signed.select("doc_id", "n", F.xxhash64("k").alias("h")), "ids")
    classes = ids.where("n > 0").groupBy("h").agg(F.min("doc_id").alias("c")).where("c is not null")

    # rare members of two classes or more; counters bound the rows of each that is not hot
    of_token = Window.partitionBy("token")
    every = signed.where("n > 0").withColumn("h", F.xxhash64("k"))
    rare = every.select("h", F.explode("rare").alias("token")).select(
        "token", "h", F.min("h").over(of_token).alias("low"), F.max("h").over(of_token).alias("high"), F.count("*").over(of_token).alias("rows")
    )
    rare = rare.where("low != high").select("token", "h", "rows").distinct()
    hot = every.select(F.explode("hot").alias("token"), "h", F.lit(hot_rows).cast("long").alias("rows")).distinct()
    cells = stages.keep(rare.unionByName(hot), "cells")

    common = cells.groupBy("h").agg(F.max(F.struct("rows", "token"))["token"].alias("common"))
    candidates = common.join(classes, "h")
    shapes = signed.select(F.col("doc_id").alias("c"), F.xxhash64("k").alias("h"), "n", "family", "bits").join(candidates, ["c", "h"])
    shapes = shapes.groupBy("h", "c", "common").agg(*[F.first(x).alias(x) for x in ("n", "family", "bits")])
    nodes = stages.keep(_grouped(shapes, group), "nodes")
    stages.drop("signed")

    def screened(rows: DataFrame) -> DataFrame:
        rows = rows.where("classes > 1").select("g", "h", "n", "bits")
        return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_screen(threshold), "h long")

    by_common = _grouped(nodes.select("h", "n", "bits", F.col("common").alias("family")), group)
    maybe = stages.keep(screened(nodes).union(screened(by_common)).distinct(), "maybe")
    texts = stages.keep(_fetched(source, nodes.select("h", "c").join(maybe, "h", "left_semi")), "texts")

    def linked(rows: DataFrame) -> DataFrame:
        return rows.select("g", "h", "text").repartition("g").sortWithinPartitions("g").mapInArrow(_inner(shingle, threshold), "h long, root long")

    plain = nodes.drop("bits")
    near = linked(plain.where("classes > 1").select("g", "h").join(texts, "h"))
    parts = stages.keep(plain.select("h").join(near, "h", "left").select("h", F.coalesce("root", "h").alias("root")), "parts")
    # centres meet again: those of split families, then all by the commonest of their rare members
    for level, (some, family) in enumerate((("split", "family"), ("true", "common"))):
        centres = plain.where(some).select("h", "n", F.col(family).alias("family")).join(parts.where("h = root").select("h"), "h", "left_semi")
        centres = centres.join(maybe, "h", "left_semi")
        centres = stages.keep(_grouped(centres, group).where("classes > 1"), f"centres{level}")
        if centres.isEmpty():
            continue
        again = linked(centres.join(texts, "h")).select(F.col("h").alias("root"), F.col("root").alias("higher"))
        parts = stages.keep(parts.join(again, "root", "left").select("h", F.coalesce("higher", "root").alias("root")), f"parts{level}")
    stages.drop("texts", "maybe")

    # the token-group matrix, of members that occur in several components; sets that link differ in size by a band at most
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-1.0001 * math.log(threshold / 100))).cast("int")
    known = stages.keep(plain.select("h", "g", band.alias("band")).join(parts, "h"), "known")
    cell = stages.keep(cells.select("token", "h").join(known, "h"), "matrix")
    stages.drop("cells")
    per_root = cell.groupBy("token", "root").agg(F.count("*").alias("n"))
    mixed = (
        per_root.groupBy("token").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("major")).where("roots > 1")
        .select("token", F.col("major.root").alias("major"))
    )
    cell = stages.keep(cell.join(mixed, "token"), "mixed")
    stages.drop("matrix")
    near_bands = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    asking = cell.where("root != major").select("token", near_bands, "h", F.col("root").alias("of"))
    columns = cell.groupBy("token", "band", "g").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    pairs = asking.join(columns, ["token", "band"]).where("not (low = of and high = of)").select("g", "h").distinct()
    pairs = stages.keep(pairs, "pairs")
    sized = known.select("h", "g", "root").join(nodes.select("h", "n", "bits"), "h")
    held = sized.join(pairs.select("g").distinct(), "g", "left_semi")
    asked = pairs.join(sized.drop("g"), "h")
    near = _dealt(held, asked, ["n", "bits"]).mapInArrow(_bound(threshold), "g long, h long, query int")
    near = stages.keep(near.distinct(), "near")
    stages.drop("mixed", "pairs")
    if near.isEmpty():
        final = parts
    else:
        wanted = nodes.select("h", "c").join(near.select("h").distinct(), "h", "left_semi")
        full = stages.keep(near.join(known.select("h", "root"), "h").join(_fetched(source, wanted), "h"), "full")
        edges = _dealt(full.where("query = 0"), full.where("query = 1"), ["text"]).mapInArrow(_outer(shingle, threshold), "src long, dst long")
        joined = connected_components(stages.keep(edges.distinct(), "edges")).select(F.col("node").alias("root"), F.col("component").alias("higher"))
        final = parts.join(joined, "root", "left").select("h", F.coalesce("higher", "root").alias("root"))

    own = final.join(nodes.select("h", "c"), "h")
    least = own.groupBy("root").agg(F.min("c").alias("component"))
    of_class = classes.join(own.join(least, "root").select("h", "component"), "h", "left").select("h", F.coalesce("component", "c").alias("component"))
    out = (
        ids.join(of_class, "h", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )
    out = stages.keep(out, "result")
    out = _one_per_id(out, stages)
    stages.drop("ids", "nodes", "parts", "parts0", "parts1", "centres0", "centres1", "known", "near", "full", "edges")
    return out


def _dealt(held: DataFrame, asked: DataFrame, more: list[str]) -> DataFrame:
    """Members and queries (g, h, root and ``more``) of each group, in parts of about QUERIES queries, sorted."""
    parts = asked.groupBy("g").agg(F.ceil(F.count("*") / F.lit(float(QUERIES))).cast("long").alias("parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    members = held.join(parts, "g").select("g", every, F.lit(0).alias("query"), "h", "root", *more)
    queries = asked.join(parts, "g").select("g", F.pmod(F.xxhash64("h"), F.col("parts")).alias("part"), F.lit(1).alias("query"), "h", "root", *more)
    return members.unionByName(queries).repartition("g", "part").sortWithinPartitions("g", "part", "query")


def _one_per_id(out: DataFrame, stages: Stages) -> DataFrame:
    """Joins the components of an id that came with several texts (as a rule there is none)."""
    torn = out.groupBy("doc_id").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"))
    torn = torn.where("doc_id is not null and low != high").select("doc_id", "low")
    if torn.isEmpty():
        return out
    edges = out.join(torn, "doc_id").select(F.col("component_id").alias("src"), F.col("low").alias("dst"))
    joined = connected_components(edges).select(F.col("node").alias("component_id"), F.col("component").alias("lower"))
    return stages.keep(
        out.join(joined, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("lower", "component_id").alias("component_id")), "joined"
    )
