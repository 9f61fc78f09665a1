"""Alignment of two tokenizers over a corpus: which tokens of one overlap which tokens of the other, and how often.

Each text is encoded by a byte-level tokenizer (A) and by a piece tokenizer (B). Two tokens are linked where their bytes
overlap; the count of a pair of ids is the number of rows that hold it linked. Method, a cogroup of postings:

1. Rows are encoded in batches. A batch writes one line a row (sums, digest of its groups) and, for every A id, its
   postings: the B ids linked to it, how many rows have each, and which rows how often.
2. Counts are added up by pair and gathered by A id, of which each has at most the vocabulary of B.
3. Postings are dealt by group of A ids and by ``TOGETHER`` batches, so that no id fills a task, sorted (Spark spills
   them) and cogrouped with the counts of their ids: maximum and counts are looked up there, and what a cogroup adds to
   each row is passed on.
4. Contributions are summed by row, a batch at a time.

Texts are cut before a space or line feed that follows no white space, where neither tokenizer has a token across (A
never joins the two; B's vocabulary is tested for it when it is loaded), and a unit that occurs often in a block of
texts is encoded once. A text of any length is encoded whole; over ``LONG`` it is taken in parts of whole units. Tests
compare with both tokenizers on whole texts.

Null and empty texts, and those that a tokenizer does not render byte for byte, have no tokens: zeros and an empty
digest. Repeated rows count as often as they occur, and ids may be null or repeated. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.store import Stages

#: Where the tokenizers' files are, on every machine.
TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Rows of a batch at most; a row is named by 15 bits in its batch.
BITS = 15
#: Links after which a batch ends, characters of texts encoded together, characters of a text taken in parts.
LINKS, BLOCK, LONG = 6_000_000, 6_000_000, 1_000_000
#: Groups of A ids, and batches whose postings of such a group are worked on together.
GROUPS, TOGETHER = 32, 16
#: Postings looked up at a time.
SLICE = 500_000

ENCODED = (
    "kind string, batch string, doc int, id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "a int, bs array<int>, ns array<int>, docs binary, ms binary"
)
_NAMES = [f.split()[0] for f in ENCODED.split(", ")]
_SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A text with this, behind a space, is cut by a pattern; others are split at spaces.
_RUN = rf"\x00|[{_SPACES}][ \n]|^[ \n]"
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Units:
    """Encodes units of text by both tokenizers and keeps what they encode to."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{A_FILE}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{B_FILE}")
        alphabet = _byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], "i8") for side in (self.a_bytes, self.b_bytes))
        self.numbers = pa.array([str(i) for i in range(max(len(self.a_bytes), len(pieces)))])
        self.space = pieces.index("▁")
        spaced = [p.replace("▁", " ") for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        self.whole = any(_CUT.search(p) or (p.strip(" ") and "\n" in p) for p in spaced)
        self.width = len(pieces)

    def encode(self, keys: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """For each key: tokens of A, tokens of B, groups, links; its groups as text (null if not rendered); where its links begin; and codes of all links."""
        units = [k if k[:1] == "\n" else k[1:] if k[:1] == "\x00" else " " + k for k in keys]
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        of_a, of_b = [], []
        for at in range(0, len(units), 20_000):
            part = units[at : at + 20_000]
            of_a += [e.ids for e in encode(part, add_special_tokens=False)]
            for u, b in zip(part, self.b.encode([u[1:] if u[0] == " " else u for u in part], num_threads=1), strict=True):
                of_b.append([self.space] if u == " " else b if u[0] == " " else b[1:] if b[:1] == [self.space] else [])
        raws = [u.encode(errors="surrogatepass") for u in units]
        a, b, n_a, n_b = self._flat(of_a, of_b)
        good = np.ones(len(units), bool)
        if b"".join(self.a_bytes[i] for i in a.tolist()) != (raw := b"".join(raws)) or b"".join(self.b_bytes[i] for i in b.tolist()) != raw or not self._sized(a, b, n_a, n_b, raws):
            good = np.array([b"".join(self.a_bytes[i] for i in x) == r == b"".join(self.b_bytes[i] for i in y) for x, y, r in zip(of_a, of_b, raws, strict=True)])
            a, b, n_a, n_b = self._flat(*([x if g else [] for x, g in zip(side, good, strict=True)] for side in (of_a, of_b)))
        # bytes end where a token of either ends: a link for each such stretch, a group where both end
        end_a, end_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        both = np.sort(np.r_[end_a, end_b], kind="stable")
        twice = both[1:] == both[:-1] if len(both) else np.zeros(0, bool)
        ends, edge = both[np.r_[True, ~twice]] if len(both) else both, both[1:][twice]
        i, j = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        codes = a[i] * self.width + b[j]
        last = np.r_[0, np.cumsum(n_a)]
        unit_ends = np.r_[0, end_a][last]
        links = np.searchsorted(ends, unit_ends, "right")
        groups = np.searchsorted(edge, unit_ends, "right")
        sides = []
        for ids, side_ends in ((a, end_a), (b, end_b)):
            bounds = pa.array(np.r_[0, np.searchsorted(side_ends, edge, "right")].astype("i4"))
            sides.append(pc.binary_join(pa.ListArray.from_arrays(bounds, self.numbers.take(pa.array(ids))), ","))
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(groups.astype("i4")), pc.binary_join_element_wise(*sides, "|")), ";")
        lines = pc.if_else(pa.array(good), lines, pa.scalar(None, pa.string()))
        return np.stack([n_a, n_b, np.diff(groups), np.diff(links)], axis=1), lines, links, codes

    def _flat(self, of_a: list, of_b: list) -> tuple[np.ndarray, ...]:
        flat = [np.fromiter(itertools.chain.from_iterable(x), "i8") for x in (of_a, of_b)]
        return (*flat, *(np.fromiter(map(len, x), "i8", len(x)) for x in (of_a, of_b)))

    def _sized(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, raws: list[bytes]) -> bool:
        """Whether the tokens of each unit have the unit's size on both sides."""
        sizes = np.cumsum([len(r) for r in raws])
        return all((np.r_[0, np.cumsum(s)][np.cumsum(n)] == sizes).all() for s, n in ((self.a_sizes[a], n_a), (self.b_sizes[b], n_b)))

    def parts(self, text: str) -> Iterator[list[str]]:
        """Keys of the units of a space and ``text``, some at a time."""
        text, at = " " + text, 0
        while at < len(text):
            cut = None if self.whole else _CUT.search(text, at + LONG)
            end = cut.start() if cut else len(text)
            yield ["\x00" + u for u in ([text[at:end]] if self.whole else _CUT.split(text[at:end]))]
            at = end


class _Batch:
    """Rows and links of one batch."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.raw: list[np.ndarray] = []
        self.packed: list[tuple[np.ndarray, np.ndarray]] = []
        self.links = 0

    def add(self, codes: np.ndarray, docs: np.ndarray | int) -> None:
        self.raw.append((codes << BITS) | docs)
        self.links += len(codes)
        if sum(map(len, self.raw)) > LINKS:
            self.pack()

    def pack(self) -> None:
        if self.raw:
            keys = np.concatenate(self.raw)
            keys.sort()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, "i8")
            self.packed.append((keys[first], np.diff(np.r_[first, len(keys)])))
            self.raw = []

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        self.pack()
        if not self.packed:
            return np.zeros(0, "i8"), np.zeros(0, "i8")
        keys, times = (np.concatenate(x) for x in zip(*self.packed, strict=True))
        if len(self.packed) > 1:
            order = np.argsort(keys, kind="stable")
            keys, times = keys[order], times[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, "i8")
            keys, times = keys[first], np.add.reduceat(times, first) if len(first) else times
        return keys, times


def _runs(values: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin, and the length behind it."""
    if not len(values):
        return np.zeros(1, "i8")
    return np.r_[np.flatnonzero(np.r_[True, values[1:] != values[:-1]]), len(values)]


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for each stretch of ``values``."""
    offsets = (bounds * values.dtype.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _table(columns: dict[str, pa.Array], n: int, kind: str, name: str) -> pa.RecordBatch:
    types = {"kind": pa.string(), "batch": pa.string(), "doc": pa.int32(), "id": pa.string(), "groups_sha256": pa.string(), "a": pa.int32(), "bs": pa.list_(pa.int32()), "ns": pa.list_(pa.int32()), "docs": pa.binary(), "ms": pa.binary()}
    columns |= {"kind": pa.array([kind] * n, pa.string()), "batch": pa.array([name] * n, pa.string())}
    return pa.RecordBatch.from_arrays([columns.get(c) if c in columns else pa.nulls(n, types.get(c, pa.int64())) for c in _NAMES], _NAMES)


def _emit(batch: _Batch, name: str, width: int) -> Iterator[pa.RecordBatch]:
    if batch.rows:
        cols = list(zip(*batch.rows, strict=True))
        made = {c: pa.array(v, pa.string() if c in ("id", "groups_sha256") else pa.int64()) for c, v in zip(("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), cols, strict=True)}
        yield _table(made | {"doc": pa.array(range(len(batch.rows)), pa.int32())}, len(batch.rows), "row", name)
    keys, times = batch.merged()
    codes, docs = keys >> BITS, (keys & ((1 << BITS) - 1)).astype("<u2")
    pairs = _runs(codes)
    codes = codes[pairs[:-1]]
    ids = _runs(codes // width)
    for at in range(0, len(ids) - 1, 2000):
        own = ids[at : at + 2001]
        lo, hi = own[0], own[-1]
        cut = pairs[own] - pairs[lo]
        span = slice(pairs[lo], pairs[hi])
        made = {
            "a": pa.array((codes[own[:-1]] // width).astype("i4")),
            "bs": pa.ListArray.from_arrays(pa.array((own - lo).astype("i4")), pa.array((codes[lo:hi] % width).astype("i4"))),
            "ns": pa.ListArray.from_arrays(pa.array((own - lo).astype("i4")), pa.array(np.diff(pairs[lo : hi + 1]).astype("i4"))),
            "docs": _binary(docs[span], cut),
            "ms": _binary(times[span].astype("<u4"), cut),
        }
        yield _table(made, len(own) - 1, "posting", name)


_UNITS: dict[str, Units] = {}


def _encoder(folder: str):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _UNITS.get(folder) or _UNITS.setdefault(folder, Units(folder))
        task, made, batch = TaskContext.get().partitionId(), 0, _Batch()

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made, batch
            yield from _emit(batch, f"{task}-{made}", units.width)
            made, batch = made + 1, _Batch()

        for rows in batches:
            ids, texts = rows.column(0), rows.column(1)
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            plain = (sizes > 0) & (sizes < LONG) & (not units.whole)
            plain &= ~pc.fill_null(pc.match_substring_regex(texts, _RUN), True).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(sizes):
                if len(batch.rows) == 1 << BITS or batch.links > LINKS:
                    yield from close()
                room = (1 << BITS) - len(batch.rows)
                end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + room]), BLOCK, "right")))
                _encode_block(units, batch, ids.slice(at, end - at).to_pylist(), texts.slice(at, end - at), sizes[at:end], plain[at:end])
                at = end
        yield from close()

    return encode


def _encode_block(units: Units, batch: _Batch, ids: list, texts: pa.Array, sizes: np.ndarray, plain: np.ndarray) -> None:
    base = len(batch.rows)
    found: list = [(0, 0, 0, 0, "")] * len(ids)
    at = np.flatnonzero(plain)
    if len(at):
        cut = pc.split_pattern(pc.replace_substring(texts.take(pa.array(at)), "\n", " \n"), " ")
        bounds, flat = cut.offsets.to_numpy(), cut.flatten()
        bounds = bounds - bounds[0]
        coded = flat.dictionary_encode()
        unit = coded.indices.to_numpy()
        sums, lines, starts, codes = units.encode(coded.dictionary.to_pylist())
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype("i4")), lines.take(coded.indices)), ";").to_pylist()
        sums = np.add.reduceat(sums[unit], bounds[:-1], axis=0).tolist()
        for d, s, text in zip(at.tolist(), sums, joined, strict=True):
            if text is not None:
                found[d] = (*s, hashlib.sha256(text.encode()).hexdigest())
        good = np.repeat([t is not None for t in joined], np.diff(bounds))
        owner = np.repeat(at + base, np.diff(bounds))[good]
        unit = unit[good]
        own = np.diff(starts)[unit]
        places = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own - starts[unit], own)
        batch.add(codes[places], np.repeat(owner, own))
    for d in np.flatnonzero(~plain & (sizes > 0)).tolist():
        total, digest, own, good = np.zeros(4, "i8"), hashlib.sha256(), _Batch(), True
        for n, keys in enumerate(units.parts(texts[d].as_py())):
            sums, lines, _, codes = units.encode(keys)
            good = good and not lines.null_count
            if not good:
                break
            total += sums.sum(axis=0)
            digest.update(((";" if n else "") + ";".join(lines.to_pylist())).encode())
            own.add(codes, base + d)
        if good:
            found[d] = (*total.tolist(), digest.hexdigest())
            own.pack()
            batch.packed += own.packed
            batch.links += own.links
    batch.rows += [(i, *f) for i, f in zip(ids, found, strict=True)]


def _expanded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and the number of each."""
    return lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("i8")


def _contribute(postings: pa.Table, counts: pa.Table) -> pa.Table:
    """What the postings of a group of A ids add to each row of some batches."""
    if not postings.num_rows:
        return ADDS.empty_table()
    counts = counts.combine_chunks()
    counts = counts.take(pa.array(np.argsort(counts.column("id").to_numpy()))).combine_chunks()
    all_b, n_all = _expanded(counts.column("all_bs").chunk(0))
    all_n, _ = _expanded(counts.column("all_ns").chunk(0))
    keys = np.repeat(counts.column("id").to_numpy().astype("i8") << 32, n_all) | all_b
    top = np.repeat(np.maximum.reduceat(all_n, np.cumsum(n_all) - n_all), n_all)
    postings = postings.combine_chunks()
    coded = postings.column("batch").chunk(0).dictionary_encode()
    sums = np.zeros((2, len(coded.dictionary) << BITS), "i8")
    weight = np.cumsum(pc.binary_length(postings.column("docs")).to_numpy() // 2)
    at = 0
    while at < postings.num_rows:
        end = max(at + 1, int(np.searchsorted(weight, weight[at] + SLICE, "right")))
        part = postings.slice(at, end - at).combine_chunks()
        (bs, n_b), (ns, _) = (_expanded(part.column(c).chunk(0)) for c in ("bs", "ns"))
        place = np.searchsorted(keys, np.repeat(part.column("a").to_numpy().astype("i8") << 32, n_b) | bs)
        docs, times = (np.frombuffer(b"".join(part.column(c).to_pylist()), t).astype("i8") for c, t in (("docs", "<u2"), ("ms", "<u4")))
        of_line = np.add.reduceat(ns.astype("i8"), np.cumsum(n_b) - n_b)
        docs |= np.repeat(coded.indices.to_numpy()[at:end].astype("i8") << BITS, of_line)
        count = all_n[place]
        np.add.at(sums[0], docs, times * np.repeat(count == top[place], ns))
        np.add.at(sums[1], docs, times * np.repeat(count, ns))
        at = end
    rows = []
    for k, name in enumerate(coded.dictionary.to_pylist()):
        own = sums[:, k << BITS : (k + 1) << BITS]
        docs = np.flatnonzero(own[1])
        rows.append({"batch": name, "docs": docs.astype("<u2").tobytes(), "best": own[0, docs].astype("<i8").tobytes(), "sums": own[1, docs].astype("<i8").tobytes()})
    return pa.Table.from_pylist(rows, ADDS)


ADDS = pa.schema([("batch", pa.string()), ("docs", pa.binary()), ("best", pa.binary()), ("sums", pa.binary())])


def _total(rows: pd.DataFrame, adds: pd.DataFrame) -> pd.DataFrame:
    sums = np.zeros((2, 1 << BITS), "i8")
    for docs, best, total in zip(adds["docs"], adds["best"], adds["sums"], strict=True):
        at = np.frombuffer(docs, "<u2")
        sums[0, at] += np.frombuffer(best, "<i8")
        sums[1, at] += np.frombuffer(total, "<i8")
    return rows.drop(columns=["batch", "doc"]).assign(n_best=sums[0, rows["doc"]], count_sum=sums[1, rows["doc"]])


def align(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row for each of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    stages = Stages(docs.sparkSession, "alignment")
    read = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    encoded = stages.keep(read.mapInArrow(_encoder(folder), ENCODED), "encoded", "kind")
    batches = encoded.where("kind = 'row'").agg(F.countDistinct("batch")).first()[0]
    parts = max(1, -(-batches // TOGETHER))
    postings = encoded.where("kind = 'posting'").select("batch", "a", "bs", "ns", "docs", "ms", (F.col("a") % GROUPS).alias("g"), F.pmod(F.xxhash64("batch"), F.lit(parts)).alias("part"))
    counts = pair_counts(encoded).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("p"))
    counts = counts.select(F.col("a").alias("id"), F.col("p.b").alias("all_bs"), F.col("p.n").alias("all_ns"), (F.col("a") % GROUPS).alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    adds = postings.groupBy("g", "part").cogroup(counts.groupBy("g", "part")).applyInArrow(_contribute, "batch string, docs binary, best binary, sums binary")
    rows = encoded.where("kind = 'row'").select("batch", "doc", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = rows.groupBy("batch").cogroup(adds.groupBy("batch")).applyInPandas(_total, "id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return out.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", "doc_id")


def pair_counts(encoded: DataFrame) -> DataFrame:
    """a, b and the rows that hold them linked, from the table that ``align`` writes."""
    each = encoded.where("kind = 'posting'").select("a", F.explode(F.arrays_zip("bs", "ns")).alias("p"))
    return each.groupBy("a", F.col("p.bs").alias("b")).agg(F.sum("p.ns").alias("n"))
