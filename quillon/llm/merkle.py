"""A Merkle manifest of a table: one root for all rows, and for every row the path that proves it.

Rows are leaves, ordered within their group; runs of ``fanout`` nodes become one until a group has a single node, and
the groups' nodes, ordered by group, become the root in the same way. Superblocks: rows get an index in their group, a
bucket is ``index div fanout**levels``, and one grouped step collapses ``levels`` levels of a bucket; its result is the
table of bucket roots, which is reduced again. On the way down a bucket meets the proof of its own root and puts the
path inside the bucket before it. A bucket never holds more than ``fanout**levels`` nodes, whatever the group's size.

A node's hash is sha256 of its children's hexadecimal digests; a last run may have fewer children, even one. Nulls in
any column, empty and very long texts are hashed as they are; rows without a group are a group of their own, before all
others; rows without an order value come first. Rows with equal order values ascend by leaf, and rows that repeat in
all columns take the places of their copies in any order. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.ordering import numbered
from quillon.store import Stages

FANOUT = 2
#: Levels that one bucket collapses: 2 ** 12 nodes of 64 bytes.
LEVELS = 12
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def row_hash(*columns: Column) -> Column:
    """sha256 of the columns: ``-`` for null, else the bytes of the value in UTF-8, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, before: Column, after: Column) -> Column:
    """The root that ``leaf`` leads to with the digests before and after it on each level."""
    return F.aggregate(F.arrays_zip(before.alias("b"), after.alias("a")), leaf, lambda node, level: F.sha2(F.concat(level["b"], node, level["a"]), 256))


def proof_digest(before: Column, after: Column) -> Column:
    """sha256 of all digests of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), ""), 256)


def _depth(size: int, fanout: int) -> int:
    depth = 0
    while size > 1:
        size, depth = -(-size // fanout), depth + 1
    return depth


def _levels(hashes: Sequence[str], depth: int, fanout: int) -> list[list[str]]:
    """The nodes of each level, from ``hashes`` to the one ``depth`` levels above."""
    out = [list(hashes)]
    for _ in range(depth):
        low = out[-1]
        out.append([hashlib.sha256("".join(low[i : i + fanout]).encode()).hexdigest() for i in range(0, len(low), fanout)])
    return out


def _bucketed(nodes: DataFrame, step: int) -> DataFrame:
    return nodes.withColumn("bucket", F.expr(f"idx div {step}L"))


def _collapse(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The bucket roots of ``nodes`` (grp, idx, size, hash), as nodes."""
    step = fanout**levels

    def collapse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        size = int(pdf["size"].iloc[0])
        top = _levels(pdf["hash"].tolist(), min(levels, _depth(size, fanout)), fanout)[-1]
        return pd.DataFrame({"grp": pdf["grp"].iloc[:1], "idx": pdf["bucket"].iloc[:1], "size": [-(-size // step)], "hash": top})

    return _bucketed(nodes.select("grp", "idx", "size", "hash"), step).groupBy("grp", "bucket").applyInPandas(collapse, "grp string, idx long, size long, hash string")


def _reduce(nodes: DataFrame, fanout: int, levels: int, stages: Stages, name: str) -> list[DataFrame]:
    """``nodes``, the bucket roots, their bucket roots and so on, down to one node a group."""
    tables, most = [nodes], nodes.agg(F.max("size")).first()[0] or 1
    while most > 1 or len(tables) == 1:
        tables.append(stages.keep(_collapse(tables[-1], fanout, levels), f"{name}-{len(tables)}"))
        most = math.ceil(most / fanout**levels)
    return tables


def _descend(nodes: DataFrame, above: DataFrame, carry: Sequence[str], fanout: int, levels: int) -> DataFrame:
    """``nodes`` with ``before`` and ``after``: their path inside the bucket, and behind it the path of the bucket root in ``above``."""
    step, passed = fanout**levels, [c for c in above.columns if c not in ("grp", "idx", "before", "after")]

    def extend(pdf: pd.DataFrame, upper: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if pdf.empty or upper.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        pdf = pdf.sort_values("idx")
        rows = _levels(pdf["hash"].tolist(), min(levels, _depth(int(pdf["size"].iloc[0]), fanout)), fanout)[:-1]
        left = [["".join(low[j - j % fanout : j]) for j in range(len(low))] for low in rows]
        right = [["".join(low[j + 1 : j - j % fanout + fanout]) for j in range(len(low))] for low in rows]
        more = {c: list(upper[c].iloc[0]) for c in ("before", "after")}
        out = pdf[["grp", "idx", "hash", *carry]].copy()
        for c, sides in (("before", left), ("after", right)):
            out[c] = [[side[j // fanout**k] for k, side in enumerate(sides)] + more[c] for j in range(len(pdf))]
        for c in passed:
            out[c] = upper[c].iloc[0]
        return out

    keep = _bucketed(nodes.select("grp", "idx", "size", "hash", *carry), step)
    fields = ["grp string", "idx long", "hash string", *[f"{c} string" for c in carry], "before array<string>", "after array<string>", *[f"{c} string" for c in passed]]
    schema = nodes.sparkSession.createDataFrame([], ", ".join(fields)).schema
    return keep.groupBy("grp", "bucket").cogroup(above.groupBy("grp", "idx")).applyInPandas(extend, schema)


def _paths(tables: list[DataFrame], above: DataFrame, carry: Sequence[str], fanout: int, levels: int, stages: Stages, name: str) -> DataFrame:
    for k in range(len(tables) - 2, 0, -1):
        above = stages.keep(_descend(tables[k], above, (), fanout, levels).drop("hash"), f"{name}-path-{k}")
    return _descend(tables[0], above, carry, fanout, levels)


def build_manifest(rows: DataFrame, leaf: Column, group: Column, order: Column, carry: dict[str, Column], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """For each row: ``carry`` (strings), ``grp``, ``idx`` in the group, ``leaf``, ``before``, ``after`` (arrays of concatenated digests, a level each), ``subroot``, ``root``.

    ``grp`` is empty for a null group, else ``=`` and the group. Other columns of ``rows`` are not read.
    """
    stages = Stages(rows.sparkSession, "merkle")
    named = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    leaves = stages.keep(rows.select(named.alias("grp"), order.alias("at"), leaf.alias("hash"), *[c.alias(n) for n, c in carry.items()]), "leaves")
    nodes = stages.keep(numbered(leaves, ["at", "hash"], stages, "leaf-order", ["grp"], "idx", "size").drop("at"), "nodes")
    tables = _reduce(nodes, fanout, levels, stages, "groups")
    tops = numbered(tables[-1].select(F.col("grp").alias("name"), "hash"), ["name"], stages, "group-order", to="idx", size="size")
    upper = _reduce(stages.keep(tops.withColumn("grp", F.lit("")), "tops"), fanout, levels, stages, "tops")
    none = F.array().cast("array<string>")
    root = upper[-1].select("grp", "idx", none.alias("before"), none.alias("after"), F.col("hash").alias("root"))
    tops = _paths(upper, root, ["name"], fanout, levels, stages, "tops")
    above = tops.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("idx"), "before", "after", F.col("hash").alias("subroot"), "root")
    return _paths(tables, stages.keep(above, "subroots"), list(carry), fanout, levels, stages, "groups").withColumnRenamed("hash", "leaf")


def verify_tampered(docs: DataFrame, columns: Sequence[str] = COLUMNS, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``docs``, and what each row proves after some are tampered with (op12).

    Rows whose id has a CRC-32 divisible by 7 have 1 added to ``n_chars``; a null there, or a null id, stays as it is.
    """
    ids, cols = F.col("doc_id"), [F.col(c) for c in columns]
    changed = [(F.col(c).cast("decimal(20,0)") + 1) if c == "n_chars" else F.col(c) for c in columns]
    picked = F.crc32(ids.cast("string").cast("binary")) % 7 == 0
    carry = {"id": ids.cast("string"), "altered": F.when(picked, row_hash(*changed))}
    found = build_manifest(docs, row_hash(*cols), F.col("lang"), ids, carry, fanout, levels)
    found = found.withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("before"), F.col("after")))
    return found.select(
        F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root",
        proof_digest(F.col("before"), F.col("after")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql_hash(n_chars: str) -> str:
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(({f})::VARCHAR)) || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


ORACLE_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_sql_hash("n_chars")} AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda d: [ord(d)::UBIGINT, 999, 999, 999, 999, 999, 999, 999, 999]))),
        lambda c, x: CASE WHEN x < 999 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384::UBIGINT) END), 4294967295::UBIGINT) % 7 = 0
      THEN {_sql_hash("n_chars + 1")} END AS altered
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM docs
), up AS (
  SELECT g, 0 AS lvl, idx, leaf AS h, n FROM leaves
  UNION ALL
  SELECT g, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY g, lvl, idx // 2, n
), tops AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1
), over_tops AS (
  SELECT 0 AS lvl, idx, subroot AS h, n FROM tops
  UNION ALL
  SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM over_tops WHERE n > 1 GROUP BY lvl, idx // 2, n
), deep AS (
  SELECT g, max(lvl) AS depth FROM up GROUP BY g
), steps AS (
  SELECT doc_id, leaf, a.idx, a.g, u.lvl, CASE WHEN (a.idx >> u.lvl) % 2 = 0 THEN '' ELSE s.h END AS b, CASE WHEN (a.idx >> u.lvl) % 2 = 0 THEN coalesce(s.h, '') ELSE '' END AS a
  FROM leaves a JOIN (SELECT DISTINCT g, lvl FROM up WHERE n > 1) u ON u.g = a.g
  LEFT JOIN up s ON s.g = a.g AND s.lvl = u.lvl AND s.idx = xor((a.idx >> u.lvl)::BIGINT, 1)
  UNION ALL
  SELECT doc_id, leaf, l.idx, l.g, d.depth + u.lvl, CASE WHEN (t.idx >> u.lvl) % 2 = 0 THEN '' ELSE s.h END, CASE WHEN (t.idx >> u.lvl) % 2 = 0 THEN coalesce(s.h, '') ELSE '' END
  FROM leaves l JOIN tops t ON t.g = l.g JOIN deep d ON d.g = l.g CROSS JOIN (SELECT DISTINCT lvl FROM over_tops WHERE n > 1) u
  LEFT JOIN over_tops s ON s.lvl = u.lvl AND s.idx = xor((t.idx >> u.lvl)::BIGINT, 1)
), folded AS (
  SELECT g, idx, 0 AS lvl, coalesce(altered, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.g, f.idx, f.lvl + 1, sha256(s.b || f.h || s.a) FROM folded f JOIN steps s ON s.g = f.g AND s.idx = f.idx AND s.lvl = f.lvl
), proofs AS (
  SELECT g, idx, sha256(string_agg(b || a, '' ORDER BY lvl)) AS p FROM steps GROUP BY g, idx
), ends AS (
  SELECT g, idx, arg_max(h, lvl) AS folded_root FROM folded GROUP BY g, idx
)
SELECT l.doc_id, l.leaf, t.subroot, r.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.h AS verified
FROM leaves l JOIN tops t ON t.g = l.g JOIN ends e ON e.g = l.g AND e.idx = l.idx
LEFT JOIN proofs p ON p.g = l.g AND p.idx = l.idx JOIN (SELECT h FROM over_tops WHERE n = 1) r ON true
"""
