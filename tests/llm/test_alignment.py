import hashlib
import os
import random
from collections import Counter

import pytest

from quillon.llm import alignment

pytestmark = pytest.mark.skipif(not os.path.isdir(alignment.TOKENIZERS), reason="no tokenizer files")


@pytest.fixture(scope="module")
def whole():
    """Both tokenizers on whole texts: ids and bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.A_FILE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/{alignment.B_FILE}")
    alphabet = alignment._byte_alphabet()

    def encode(text):
        e = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in e.ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return left, right

    return encode


def brute(rows, encode):
    seen, links, out = Counter(), {}, {}
    for k, (_, text) in enumerate(rows):
        left, right = encode(text) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
            out[k] = [0, 0, 0, 0, ""]
            links[k] = []
            continue
        spans = []
        for side in (left, right):
            at, mine = 0, []
            for i, x in side:
                mine.append((at, at + len(x), i))
                at += len(x)
            spans.append(mine)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, at = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for s, t, i in side if at <= s and t <= e) for side in spans))
            at = e
        links[k] = [(i, j) for s, t, i in spans[0] for u, v, j in spans[1] if s < v and u < t]
        out[k] = [len(left), len(right), len(groups), len(links[k]), hashlib.sha256(";".join(groups).encode()).hexdigest()]
        seen.update(set(links[k]))
    top = {}
    for (i, _), n in seen.items():
        top[i] = max(top.get(i, 0), n)
    return sorted((rows[k][0] is not None, rows[k][0] or 0, *out[k], sum(seen[p] == top[p[0]] for p in links[k]), sum(seen[p] for p in links[k])) for k in out)


ODD = ["", None, " ", "\n", "  two  spaces \n\n and\r\nlines \t tabs\n", "a", " lead", "trail ", "é ü ñ 中文 字 🙂 👩‍👩‍👧 　wide", "<|endoftext|> plain </s> <0x41>", "▁ mark", "nul\x00byte \x00", "it's we'll 'tis\n'sup", " nbsp   sep \x1c fs", "x" * 5000, "12345 67,890.12 ... !!! ---"]


def rows_of(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "oranth", "eaux", "quevireier", "naïve", "don't", "42", "3.14", "—", "été", "ß", "\n", "\n\n", " ", "\t", "foo.\nBar", "語", "🙂"]
    made = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(n)]
    return made + [(1000 + i, t) for i, t in enumerate(ODD)] + [(3, "the oranth"), (3, "the oranth"), (None, "eaux the"), (None, None)]


@pytest.mark.parametrize(("links", "block", "long"), [(6_000_000, 3_000_000, 1_000_000), (500, 200, 60)])
def test_alignment_against_whole_texts(spark, whole, links, block, long):
    rows = rows_of(120, links)
    old = alignment.LINKS, alignment.BLOCK, alignment.LONG
    encode = alignment._encoder(alignment.TOKENIZERS)

    def small(batches):
        alignment.LINKS, alignment.BLOCK, alignment.LONG = links, block, long
        try:
            yield from encode(batches)
        finally:
            alignment.LINKS, alignment.BLOCK, alignment.LONG = old

    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, a int, batch string").repartition(3)
    kept, alignment._encoder, alignment.TOGETHER = (alignment._encoder, alignment.TOGETHER), lambda folder: small, 3
    try:
        got = alignment.align(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()
    finally:
        alignment._encoder, alignment.TOGETHER = kept
    assert sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in got) == brute(rows, whole)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
