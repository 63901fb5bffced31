import random
import time

import numpy as np
import pytest

from geomill.llm import html

ARTICLE = "<html><head><title>t</title></head><body><nav>Home | About</nav><header>Site</header><article><h1>Head &amp; tail</h1><p>One  two\n three.<p>Four &eacute;&#39;s<script>x()</script> five</p><div class='ad'>Buy</div></article><aside>More</aside><div id=\"comments\"><p>First!</p></div><footer>(c)</footer></body></html>"


def text_of(page):
    return "\n\n".join(t for t, role, _ in html.lines(page) if not role)


def test_article_text():
    assert text_of(ARTICLE) == "Head & tail\n\nOne two three.\n\nFour é's five"


def test_broken_and_empty_markup():
    assert text_of(None) == "" and text_of("") == "" and text_of("<script>var a = '<p>no</p>'") == ""
    assert text_of("<p>a<br>b <b>bold</b><!-- c --> d") == "a b bold d"
    assert text_of("<ul><li>x<li>y</ul></div>z") == "x\n\ny\n\nz"
    assert text_of("5 < 6 &lt;tag&gt;") == "5 < 6 <tag>"


def brute_lcs(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
    return n[0][0]


@pytest.mark.parametrize("matches", [10**6, 0])
def test_shared_lines_are_a_longest_common_subsequence(matches):
    draw = random.Random(1)
    for _ in range(150):
        many = draw.choice((2, 5, 30))
        a, b = ([draw.randrange(many) for _ in range(draw.randrange(30))] for _ in range(2))
        mask = html.shared_lines(np.array(a, np.int64), np.array(b, np.int64), matches)
        kept = [x for x, m in zip(a, mask) if m]
        it = iter(b)
        assert all(x in it for x in kept) and len(kept) == brute_lcs(a, b)


def test_class_names_that_only_mention_boilerplate_keep_their_article():
    assert text_of('<div class="content has-sidebar"><p>One</p></div>') == "One"
    assert text_of('<div class="post comments-open"><p>One</p></div><div class="comments-area">No</div>') == "One"
    assert text_of('<p title="a>Text one</p><div class="x">two</div>') == "Text one\n\ntwo"
    assert text_of("<p a='x\"y' b=\"1>2\">t</p>") == "t"
    assert text_of('<div class="sidebar"><p>All there is</p></div>') == "All there is"


def test_bad_quotes_and_very_many_lines_end_soon():
    began = time.time()
    html.lines('<a "' * 250_000)
    html.lines('<a x="' * 200_000)
    html.lines("<div>" * 100_000 + "x")
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 40, 50_000), draw.integers(0, 40, 50_000)
    assert html.shared_lines(a, b).sum() > 10_000
    assert time.time() - began < 60


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], "page_id long, url string, html string, id long, host string")


def test_lines_that_near_pages_share_go(spark):
    rows = [(i, f"https://Site.example/blog/{i}.html", f"<div>Welcome back</div><div>Story {i} body</div><div>Second line {i}</div><div>All rights</div>") for i in range(6)]
    rows.append((9, "https://alone.example/a", "<div>Welcome back</div><div>Only</div>"))
    got = {r.page_id: r for r in html.extract(pages(spark, rows)).collect()}
    assert all(got[i].text == f"Story {i} body\n\nSecond line {i}" and got[i].n_chars == len(got[i].text) for i in range(6))
    assert got[9].text == "Welcome back\n\nOnly"


def test_copies_of_a_page_keep_their_text(spark):
    page = "".join(f"<div>line {i}</div>" for i in range(8))
    got = html.extract(pages(spark, [(1, "h.example/x/1", page), (2, "h.example/x/2", page)])).collect()
    assert all(r.n_chars == len("\n\n".join(f"line {i}" for i in range(8))) for r in got)


def test_short_pages_of_a_long_template(spark):
    top = "".join(f"<div>template {i}</div>" for i in range(13))
    rows = [(i, f"h.example/x/{i}", f"{top}<div>own {i} a</div><div>own {i} b</div><div>own {i} c</div>") for i in range(5)]
    assert {r.text for r in html.extract(pages(spark, rows)).collect()} == {f"own {i} a\n\nown {i} b\n\nown {i} c" for i in range(5)}


def test_notices_inside_articles_go_and_copied_articles_stay(spark):
    article = lambda i: f"<article><h1>Head {i}</h1><p>Share this story now</p><p>{f'Paragraph {i} of some length. ' * 5}</p></article>"
    rows = [(i, f"h.example/x/{i}", f"<div>Menu {i}</div>{article(i if i < 6 else 1)}") for i in range(12)]
    got = {r.page_id: r.text for r in html.extract(pages(spark, rows)).collect()}
    assert all(f"Paragraph {i if i < 6 else 1} of" in t for i, t in got.items())
    assert all("Share this" not in got[i] and "Menu" not in got[i] for i in range(4))


def brute_extract(rows):
    """The rules of ``extract`` over lists: (page_id, host, path, page) with one page a path."""
    rows = sorted(rows, key=lambda r: r[1:3])
    parsed = [html.lines(r[3]) for r in rows]
    out = {}
    for i, (page_id, host, path, _) in enumerate(rows):
        mine = [t for t, _, _ in parsed[i]]
        near = [j for j in range(max(0, i - html.REACH), min(len(rows), i + html.REACH + 1)) if j != i and rows[j][1] == host and [t for t, _, _ in parsed[j]] != mine]

        def shared(a, b):
            k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            return k

        near.sort(key=lambda j: (-shared(path, rows[j][2]), abs(j - i), j - i))
        votes = [0] * len(mine)
        near = near[: html.NEIGHBOURS]
        for j in near:
            for k, m in enumerate(html.shared_lines(np.array([hash(t) for t in mine]), np.array([hash(t) for t, _, _ in parsed[j]]))):
                votes[k] += m
        need = len(near) if len(near) < 3 else len(near) - 1
        gone = [bool(near) and v >= need for v in votes]
        for kind, least in ((True, html.ARTICLE_STAYS), (False, html.PAGE_STAYS)):
            part = [k for k, (_, role, inside) in enumerate(parsed[i]) if not role and inside == kind]
            if sum(len(mine[k]) for k in part if not gone[k]) < least * sum(len(mine[k]) for k in part):
                for k in part:
                    gone[k] = False
        out[page_id] = "\n\n".join(t for k, (t, role, _) in enumerate(parsed[i]) if not gone[k] and not role)
    return out


def test_extraction_equals_brute_force(spark, monkeypatch):
    draw = random.Random(3)
    rows = []
    for i in range(90):
        host = f"h{draw.randrange(3)}.example"
        style = draw.randrange(3)
        body = [f"<p>Text {draw.randrange(60)} of a page</p>" for _ in range(draw.randrange(1, 7))]
        site = [f"<div>Site {host} line {k}</div>" for k in range(draw.randrange(3, 6))]
        inner = "".join(body[:2] + ["<p>Share this</p>"] + body[2:])
        rows.append((i, host, f"/{draw.choice('ab')}/{i:03}", "".join(site) + (f"<article>{inner}</article>" if style else inner) + f"<footer>Foot {i}</footer>"))
    want = brute_extract(rows)
    monkeypatch.setattr(html, "BLOCK_PAGES", 16)
    got = {r.page_id: r.text for r in html.extract(pages(spark, [(i, f"http://{h}{p}", page) for i, h, p, page in rows])).collect()}
    assert got == want and any("Share" not in t for t in got.values())


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, ""), (1, None, ""), (2, "x", "<p>" + "w " * 40_000), (3, "ftp://h/p?q#f", ARTICLE), (3, "ftp://h/p?q#f", ARTICLE)]
    got = html.extract(pages(spark, rows)).collect()
    assert len(got) == 6 and sum(r.text == "" for r in got) == 3 and max(r.n_chars for r in got) == 79_999
    assert html.extract(pages(spark, [])).count() == 0


def test_roles_give_way_where_they_hold_the_page():
    assert text_of('<body><form id="aspnetForm"><div id="content"><h1>T</h1><p>Para one.</p></div></form></body>') == "T\n\nPara one."
    assert text_of("<form><article><p>Art in form.</p></article></form>") == "Art in form."
    assert text_of("<form><nav>Home</nav><article><p>Art in form.</p><form>Mail</form></article><footer>f</footer></form>") == "Art in form."
    assert text_of("<aside><p>All of the page lies here.</p></aside><nav>menu</nav>") == "All of the page lies here."
    assert text_of("<nav>menu</nav><footer>foot</footer>") == ""
    assert text_of("<article><p>Text</p></article><aside><article>Teaser</article></aside><form><p>Subscribe to us</p></form>") == "Text"


def test_text_beside_a_small_article_stays():
    page = '<div class="story"><p>Long main text of the page, told in many words.</p></div><section><article><h3>Teaser card</h3></article></section>'
    assert text_of(page).startswith("Long main text")
    assert text_of("<div>Skip</div><article><p>The text of the page</p></article><div>Tags</div>") == "The text of the page"


def test_copies_do_not_use_up_the_places(spark):
    top, low = ["Site name", "Menu of the site"], ["All rights reserved"]
    make = lambda own: "".join(f"<p>{x}</p>" for x in [*top, *own, *low])
    rows = [(i, f"http://h.org/a/{i:03}", make(["Copied text one", "Copied text two", "Copied text three"])) for i in range(12)]
    rows += [(i, f"http://h.org/a/{i:03}", make([f"Own text {i} {k}" for k in range(3)])) for i in range(20, 24)]
    got = {r.page_id: r.text for r in html.extract(pages(spark, rows)).collect()}
    assert {got[i] for i in range(12)} == {"Copied text one\n\nCopied text two\n\nCopied text three"}
    assert all(got[i] == "\n\n".join(f"Own text {i} {k}" for k in range(3)) for i in range(20, 24))
