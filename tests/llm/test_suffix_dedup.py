import hashlib
import random
from collections import Counter

import pytest

from quillon.llm import suffix_dedup
from quillon.store import Stages


@pytest.mark.parametrize("base", [0, 10**6])
def test_suffix_ranks_against_sorting(spark, base):
    rng = random.Random(base)
    words = ["", "a", "ab", "abab" * 9, "aaaaaaa", "banana" * 4, "banana" * 4, "mississippi"] + ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(25)]
    rows = [(k, k % 2, i, ord(c)) for k, w in enumerate(words) for i, c in enumerate(w)]
    got = suffix_dedup.suffix_ranks(spark.createDataFrame(rows, "t long, r long, i long, sym long"), Stages(spark, "sa"), base).collect()
    suffixes = {(k, k % 2, i): w[i:] for k, w in enumerate(words) for i in range(len(w))}
    order = sorted(suffixes.values())
    assert {(r["t"], r["r"], r["i"]): r["rank"] for r in got} == {at: order.index(s) + 1 for at, s in suffixes.items()}


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raws, strict=True):
        gone = [False] * len(r)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(length // 8, length // 2)) for _ in range(4)]
    rows = [(k, text(rng.randint(0, 5)) + rng.choice(passages)[rng.randint(0, 9) :] + text(rng.randint(0, 40))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(8)]  # copies
    base = text(120)
    for k in range(25):  # near copies
        p = rng.randrange(len(base))
        rows.append((200 + k, base[:p] + "#" * (k % 4) + base[p + k % 3 :]))
    rows += [(300, "ab" * length), (301, "x" * (3 * length)), (302, None), (303, ""), (304, "y" * length), (305, "y" * length), (306, "z" * length), (307, "q" * (length + 1))]
    return rows + [(3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (None, None), (400, text(9) + passages[0] + passages[1] + passages[0])]


@pytest.mark.parametrize(("length", "gram", "cell", "base"), [(40, 8, 4096, 10**6), (40, 8, 4, 150)])
def test_removal_against_brute_force(spark, length, gram, cell, base):
    rows = rows_of(length * cell, length)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, name long, sha string").repartition(3)
    got = [tuple(r) for r in suffix_dedup.remove_repeats(docs, length, gram, cell, base).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute(rows, length)


def test_blocks_and_long_texts(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    raw = rng.integers(97, 100, 9000).astype(np.uint8)
    bounds = np.array([0, 0, 700, 750, 8000, 9000])
    whole = suffix_dedup.anchors_of(raw, bounds, 100, 12)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 512)
    assert all((a == b).all() for a, b in zip(whole, suffix_dedup.anchors_of(raw, bounds, 100, 12), strict=True))
    text, lo, hi, _ = whole  # every start of every text has one anchor
    for t in range(5):
        own = sorted(zip(lo[text == t], hi[text == t], strict=True))
        n = bounds[t + 1] - bounds[t] - 99
        assert [p for a, b in own for p in range(a, b + 1)] == list(range(max(n, 0)))


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
