import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import merkle

ROW = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def paths(hashes, fanout):
    """(root, for each leaf its siblings by level) of one sequence."""
    found = [[] for _ in hashes]
    at = list(range(len(hashes)))
    while len(hashes) > 1:
        for k, j in enumerate(at):
            low = j - j % fanout
            found[k].append(("".join(hashes[low:j]), "".join(hashes[j + 1 : low + fanout])))
        hashes = [sha("".join(hashes[i : i + fanout])) for i in range(0, len(hashes), fanout)]
        at = [j // fanout for j in at]
    return hashes[0], found


def brute(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: paths([leaf_of(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0], leaf_of(r)))], fanout) for g in order}
    root, tops = paths([trees[g][0] for g in order], fanout)
    out = []
    for g, top in zip(order, tops, strict=True):
        for r, path in zip(sorted(groups[g], key=lambda r: (r[0] is not None, r[0], leaf_of(r))), trees[g][1], strict=True):
            changed = (*r[:3], r[3] + 1, r[4]) if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else r
            node = leaf_of(changed)
            for b, a in path + top:
                node = sha(b + node + a)
            out.append((r[0], leaf_of(r), trees[g][0], root, sha("".join(b + a for b, a in path + top)), node, node == root))
    return sorted(out, key=str)


ROWS = [
    (i, None if i % 5 == 0 else f"s{i % 3}", [None, "", "en", "en", "en", "fr", "é"][i % 7], None if i % 11 == 0 else i * 7, [None, "", "x" * 70000, "ä\n", "plain"][i % 5])
    for i in range(75)
] + [(None, "s", "en", 1, "t"), (9, "s1", "en", 63, "again"), (9, "s1", "en", 63, "again"), (7, None, "one", None, "lone"), (2**62, "s", "en", 2**63 - 1, "big")]


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 3), (2, 12), (3, 2)])
def test_manifest_against_brute_force(spark, fanout, levels):
    docs = spark.createDataFrame(ROWS, ROW).withColumn("idx", F.lit(1)).withColumn("_place", F.lit("x"))
    got = [tuple(r) for r in merkle.verify_tampered(docs, fanout=fanout, levels=levels).collect()]
    assert sorted(got, key=str) == brute(ROWS, fanout)


def test_empty_table_and_one_row(spark):
    assert merkle.verify_tampered(spark.createDataFrame([], ROW)).count() == 0
    one = [(4, "a", None, 1, "b")]
    assert [tuple(r) for r in merkle.verify_tampered(spark.createDataFrame(one, ROW)).collect()] == brute(one)
