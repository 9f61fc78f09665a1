import random

import pytest

from quillon.llm import pii


def card(rng, good):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    last = next(d for d in "0123456789" if pii.luhn(body + d) == good)
    return body + last


MAKE = {
    "card": lambda r: card(r, r.random() < 0.5),
    "phone": lambda r: f"+{r.choice(['1', '49', '351'])}{r.randint(200_000_000, 999_999_999)}",
    "ssn": lambda r: f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}",
    "ip": lambda r: ".".join(str(r.randint(0, 255)) for _ in range(4)),
    "iban": lambda r: "DE" + "".join(r.choice("0123456789") for _ in range(20)),
    "email": lambda r: "".join(r.choice("abcdef") for _ in range(4)) + "@site.org",
    "secret": lambda r: "".join(r.choice("0123456789abcdef") for _ in range(32)),
    "name_o": lambda r: r.choice("BDKLM") + "".join(r.choice("aeo") for _ in range(2)),
}


@pytest.mark.parametrize("kind", sorted(MAKE))
def test_distinct_entities_have_distinct_surrogates_of_their_format(kind):
    rng, own = random.Random(kind), pii.Surrogates("k")
    originals = sorted({MAKE[kind](rng) for _ in range(400)})
    images = [own._of(kind, x) for x in originals]
    assert len(set(images)) == len(originals) and all(a != b for a, b in zip(originals, images, strict=True))
    assert images == [pii.Surrogates("k")._of(kind, x) for x in originals] != [pii.Surrogates("other")._of(kind, x) for x in originals]
    for a, b in zip(originals, images, strict=True):
        assert kind == "ip" or [c.isdigit() for c in a] == [c.isdigit() for c in b] or kind in ("secret", "iban")
        if kind == "card":
            assert pii.luhn(a) == pii.luhn(b)
        if kind == "ip":
            x, y = ([int(n) for n in v.split(".")] for v in (a, b))
            assert pii._private(x) == pii._private(y) and max(y) < 256
        if kind == "phone":
            code = pii._dialling(a[1:])
            assert a[1 : code + 1] == b[1 : code + 1]


def test_one_entity_in_several_spellings():
    own = pii.Surrogates("k")
    plain = lambda x: "".join(c for c in own._of("phone", x) if c.isdigit()).removeprefix("00")
    assert len({plain(x) for x in ("+1 555 123 4567", "+15551234567", "+1-555-123-4567", "001 555 123 4567", "+1 (555) 123-4567")}) == 1
    assert own._of("card", "4111 1111 1111 1111").replace(" ", "") == own._of("card", "4111111111111111")
    assert own._of("name_o", "SMITH") == own._of("name_m", "Smith").upper() and own._of("name_f", "MARIA") == own._of("name_o", "Maria").upper()
    assert own._of("email", "John.Doe@Site.org").lower() == own._of("email", "john.doe@site.org")


def test_edges_of_the_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "Mail a@b.org", "x"), (3, "Mail a@b.org", "y"), (3, "Mail a@b.org", "y"), (4, "w " * 200_000 + "call +1 555 123 4567", "z")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, name string, n_email int")
    got = {(r["doc_id"], r["n_entities"]) for r in pii.pseudonymize(docs).collect()}
    assert got == {(1, 0), (2, 0), (None, 1), (3, 1), (4, 1)} and pii.pseudonymize(docs).count() == len(rows)
    assert pii.replace_in(docs).columns == docs.columns and pii.pseudonymize(docs.where("doc_id < 0")).count() == 0
