import random

from quillon.llm import html_extract


def lcs(a, b):
    """Places in a of one longest common subsequence, by the table; the choice among several is that of the operator."""
    return html_extract.shared_lines(a, b)


def brute(pages):
    """Text of each page from all pages of its host in order, without ranges or hashes."""
    parsed = {}
    for pid, host, path, page in pages:
        lines, kinds = html_extract.lines_of(page or "")
        parsed[pid] = (host, path, html_extract._digest(lines, kinds), lines, kinds)
    out = {}
    for pid, (host, path, digest, lines, kinds) in parsed.items():
        order = sorted({(p, d) for h, p, d, _, _ in parsed.values() if h == host})
        of = {(p, d): x for h, p, d, x, _ in parsed.values() if h == host}
        at = order.index((path, digest))
        before = next((k for k in reversed(order[:at]) if k[1] != digest), None)
        after = next((k for k in order[at + 1 :] if k[1] != digest), None)
        near = [k for k in (before, after) if k]
        gone = set()
        if near:
            steps = [html_extract._common(path, k[0]) for k in near]
            best = near[1] if len(near) == 2 and steps[1] > steps[0] else near[0]
            gone |= {i for i in lcs(lines, of[best]) if kinds[i] != html_extract.ARTICLE}
        out[pid] = "\n\n".join(html_extract.main_lines(lines, kinds, gone))
    return out


def test_pairs_against_brute_force(spark):
    """Marked and unmarked pages, copies in a row, repeated rows; ranges are smaller than hosts."""
    rng, rows = random.Random(3), []
    frame = ["Welcome to the site", "All about us", "Follow the news", "Top"]
    for i in range(160):
        host, path = rng.choice(["h.com", "h.com", "i.org"]), f"/{rng.choice('abc')}/{rng.randrange(70):02d}"
        own = [f"<p>{rng.choice(['One', 'Two'])} text {rng.randrange(12)} of this page.</p>" for _ in range(rng.randint(1, 4))]
        head = "".join(f"<div>{x}</div>" for x in rng.sample(frame, 3))
        body = "".join(own) if i % 3 else f"<article><h2>Share this</h2>{''.join(own)}</article>"
        if i % 10 == 0:
            body, head = "<p>The same page everywhere.</p>", ""
        rows.append((i, f"http://{host}{path}?x={i}", f"<html><body><nav>menu</nav>{head}{body}</body></html>", host, path))
    frame_of = spark.createDataFrame([(r[0], r[1], r[2], "clash", 1) for r in rows] + [(rows[0][0], rows[0][1], rows[0][2], "clash", 1)], "page_id long, url string, html string, lines string, part int")
    got = html_extract.extract_pages(frame_of).collect()
    want = brute([(r[0], r[3], r[4], r[2]) for r in rows])
    assert len(got) == len(rows) + 1
    assert {r["page_id"]: r["text"] for r in got} == want
    assert sum(r["n_shared"] for r in got) > 50


def test_masses_without_url_and_borders(spark):
    rows = [(i, None if i % 2 else "no url", f"<p>Page {i % 40} has its own text here.</p><div>Frame</div>") for i in range(200)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"Page {i % 40} has its own text here." for i in range(200)}
    spans = [(0, ["b", "a"], ["a", "b"]), (1, ["c"], ["c"]), (2, ["c"], ["c"]), (3, ["d", "c"], ["c", "d"])]
    page = {x: ("h", f"/{x}{p}", x, x) for p in "0" for x in "abcd"}
    found = html_extract._borders([(p, [page[x] for x in f], [page[x] for x in z]) for p, f, z in spans])
    assert (1, page["b"]) in found and (2, page["b"]) in found and (3, page["b"]) in found and (1, page["d"]) in found and (2, page["d"]) in found


def test_long_pages_are_halved(monkeypatch):
    monkeypatch.setattr(html_extract, "CELLS", 50)
    rng = random.Random(5)
    for _ in range(100):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 40))] for _ in range(2))
        got = html_extract.shared_lines(a, b)
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert len(got) == t[-1][-1]
        it = iter(b)
        assert all(x in it for x in [a[i] for i in sorted(got)])


def text_of(page):
    return html_extract.main_lines(*html_extract.lines_of(page))


def test_article_headings_stay(spark):
    page = lambda k: f"<article><h2>Introduction</h2><p>Text {k}.</p><h2>References</h2></article>"
    rows = [(k, f"http://h.com/{k}", page(k)) for k in range(3)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: f"Introduction\n\nText {k}.\n\nReferences" for k in range(3)}


def test_comments_and_what_follows_them():
    assert text_of('<article><p>One</p></article><section class="comments"><article>c1</article><article>c2</article></section>') == ["One"]
    assert text_of('<article><p>One</p><article class="comment">..</article><p>Two</p></article>') == ["One", "Two"]
    assert text_of('<article>One<div class="comment-list"><article>a</article><div><article>b</article></div></div><p>Two</article><p>three') == ["One", "Two"]
    assert text_of('<aside><article>teaser</article></aside><main><p>One</main><footer>f') == ["One"]
    assert text_of('<div class="ad">Buy<article><p>One</p></article>') == ["One"]
    assert text_of('<nav><ul><li>a<li>b</ul><article><p>One</article>') == ["One"]


def test_names_of_chrome_inside_and_outside_of_articles():
    inside = '<article><section id="related-work"><p>A</p></section><p class="notice">B</p><div class="social-science">C</div><div class="header">D</div></article>'
    assert text_of(inside) == ["A", "B", "C", "D"]
    assert text_of('<article><p>A</p><div class="share-buttons">x</div><div class="related-posts">y</div><ul class="ad-slot-2"><li>z</ul>B</article>') == ["A", "B"]
    assert text_of('<div class="header">x</div><div id="cookie-banner">y</div><p>A</p><div class="masthead">z</div>') == ["A"]
    assert text_of("<article><p>Hello <span hidden>x</span>there<p>you</article>") == ["Hello there", "you"]
