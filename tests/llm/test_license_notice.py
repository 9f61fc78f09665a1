import random
import re
import string

from quillon.llm import license_scan

ALL = sorted({label for label, _, _ in license_scan.TEMPLATES})


def test_a_licence_counts_whatever_else_is_in_the_file(spark):
    opening = {}
    for label, words, _ in license_scan.TEMPLATES:
        opening.setdefault(label, words)
    some = ["mit", "bsd", "mpl", "proprietary"]
    docs = [(0, ". ".join(o for _, o, _ in license_scan.TEMPLATES)), (1, ". ".join(opening[x] for x in some))]
    docs += [(10 + i, opening[x]) for i, x in enumerate(ALL)] + [(100 + i, "plain words about nothing in particular") for i in range(40)]
    got = {r["doc_id"]: (r["labels"].split(","), r["score"]) for r in license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == (ALL, 1.0) and got[1] == (sorted(some), 1.0)
    assert all(x in got[10 + i][0] for i, x in enumerate(ALL))


def test_words_and_base_against_brute_force(spark):
    rng, signs = random.Random(4), "aZ09 éKİß_-.\n\x7f"
    parts = ["mit", "license", "MIT License", "apache", "general public license", "General", "public", "of"]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.3 else rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["mit license " * 3000, "", None]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        found = {k: [j for j in range(len(words)) if words[j : j + len(p.split())] == p.split()] for p, k in license_scan.BASE}
        at = sorted(j for x in found.values() for j in x)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), at[0] if at else None, at[-1] if at else None), text
        assert r["base_labels"] == ",".join(sorted(k for k, v in found.items() if v))
