from quillon.llm import pii


def test_names_after_punctuation_and_without_address():
    s = pii.Surrogates("k")
    for text, names in [
        ("They met (Mr. Smithson) there.", ["Smithson"]), ('She said "Dr. Joneson is in".', ["Joneson"]), ("Da kam «Herr Müller» an.", ["Müller"]),
        ("Then Anna Bergmann spoke with John Carter.", ["Anna", "Bergmann", "John", "Carter"]), ("Anna Maria Lopez, (Peter Novak)", ["Anna", "Maria", "Lopez", "Peter", "Novak"]),
    ]:
        out, counts, _ = s.replace(text)
        assert counts == {"name": len(names)} and not any(n in out for n in names)
    assert s.replace("Mark the page and grace the hall.")[1] == {}


def test_one_surrogate_for_a_name_in_all_texts():
    s = pii.Surrogates("k")
    names = pii.GIVEN["m"]
    alone = {n: s.replace(f"Mr. {n} spoke.")[0].split()[1] for n in names}
    for n in names:
        for other in (alone[n], *names[:5]):
            out = s.replace(f"Mr. {n} spoke. Mr. {other} heard.")[0].split()
            assert out[1] == alone[n] and out[4] == alone[other]
    assert len(set(alone.values())) == len(names) and all(a != b for a, b in alone.items())
    assert s.replace("Mr. Lee spoke.")[0].split()[1] == s.replace("Dr. Lee spoke.")[0].split()[1]


def test_permutations_have_no_fixed_point():
    p = pii.Permuter("k")
    for n in (2, 3, 10, 97, 1000):
        image = [p.number(x, n, "t") for x in range(n)]
        assert sorted(image) == list(range(n)) and all(x != y for x, y in enumerate(image))


def test_other_names_never_become_given_ones():
    s = pii.Surrogates("k")
    words = [f"{a}{b}{c}a" for a in "LMRT" for b in "aeiou" for c in "lnrs"]
    images = [s._of("name_o", w) for w in words if w not in pii._GENDER]
    assert len(set(images)) == len(images) and not set(images) & set(pii._GENDER)
    assert s.replace("Mr. กขค spoke.")[0] != "Mr. กขค spoke."


def test_no_break_blanks():
    out, counts, _ = pii.Surrogates("k").replace("Then Anna\xa0Bergmann spoke.")
    assert counts == {"name": 2} and "Anna" not in out and "Bergmann" not in out and "\xa0" in out
