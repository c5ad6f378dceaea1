import math
import random
import re

import numpy as np
import pytest

from lodestat.llm import html_extract, knn_join


def floors(v):
    return [math.floor(1024 * x) if abs(x) < 2**53 else int(x) * 1024 for x in v]


def brute_force(rows, k, modulus):
    """Every pair in whole numbers of any size; several rows of one query id share a ranking."""
    valid = [(i, floors(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q in sorted({i for i, _ in valid if i % modulus == 0}):
        pairs = [(max(min(-sum(x * y for x, y in zip(a, b, strict=False)), 10**38 - 1), 1 - 10**38), i) for j, a in valid if j == q for i, b in valid if i != q]
        want += [(q, r + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(sorted(pairs)[:k])]
    return sorted(want)


def searched(spark, rows, k=10, modulus=10, kind="double", **settings):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, cell int")
    return sorted(tuple(r) for r in knn_join.top_k(df, k=k, query_modulus=modulus, **settings).collect())


def test_top_k_is_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.2, (300, 8)).round(2)
    x[50:120] = x[0]  # a large group of copies
    rows = list(enumerate(x.tolist()))
    rows += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (500, [0.1] * 7), (None, [0.1] * 8), (600, [float("inf")] * 8), (10, x[3].tolist()), (610, []), (20, x[20].tolist())]
    want = brute_force(rows, 10, 10)
    assert searched(spark, rows, max_pivots=7, chunk=16, pack=5) == want
    assert searched(spark, rows, chunk=2, pack=1) == want  # several salts in a cell
    assert searched(spark, rows[:3], modulus=1) == brute_force(rows[:3], 10, 1)
    assert searched(spark, [], modulus=1) == [] and searched(spark, [(1, None)], modulus=1) == []


def test_top_k_keeps_every_valid_vector(spark):
    rng = np.random.default_rng(1)
    plane = [(i, v) for i, v in enumerate(rng.normal(0, 1, (200, 2)).round(3).tolist())]
    for extra in ([(1000 + i, [float("nan"), 1.0]) for i in range(64)], [(1000, [1.0, 2.0, 3.0])], [(1000 + i, [0.5] * (3 + i)) for i in range(5)], [(200, [1e13, -1e13]), (207, [3e12, 1.0]), (300, [1e300, 1e300]), (301, [-1e307, 2.0])]):
        rows = extra + plane
        assert searched(spark, rows, modulus=100) == brute_force(rows, 10, 100), extra[0]
    wide = [(i, rng.normal(0, 1, 1500).round(2).tolist()) for i in range(30)]
    assert searched(spark, wide, kind="float") == brute_force([(i, np.array(v, np.float32).tolist()) for i, v in wide], 10, 10)


def test_bounds_spare_cells_of_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 1, (40, 16))
    rows = [(i, (centers[i % 40] + rng.normal(0, 0.05, 16)).round(3).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plan = knn_join.search(df, 10, "vec_id", "embedding", 50, 1024, 1024, 4096, 1024)
    assert plan.cells > 20 and plan.share() < 0.5
    assert sorted(tuple(r) for r in knn_join.top_k(df, query_modulus=50).collect()) == brute_force(rows, 10, 50)


PAGES = {
    "plain": ("<html><head><title>T</title><style>p{}</style></head><body><nav><a>m</a></nav><article><h1>A  &amp; B</h1><p>One\n two <b>three</b>.<p>Four<br>five</article><footer>f</footer>", "A & B\nOne two three.\nFour five"),
    "inside": ("<body><article><header><h1>H</h1></header><p>x</p><div class='ad'>buy</div><aside>s</aside><form>f</form><script>var a='</p>';</script><!-- c --><section id=comments><p>first!</p></section><ul><li>a<li>b</ul></article>", "H\nx\na\nb"),
    "none": ("<body><div id=content><p>Main text that is long.</p></div><div class=sidebar>side</div></body>", "Main text that is long."),
    "broken": ("<article><p>a &lt;b&gt; &amp &quo <i>c</p></article", "a <b> & &quo c"),
    "empty": ("", ""),
    "null": (None, ""),
    "tables": ("<main><table><tr><td>1</td><td>2</td></tr></table><pre>x\n y</pre></main>", "1\n2\nx y"),
    "notice": ("<body><div class='cookie-notice'>We use cookies</div><article>Bare text &#233; &nbsp; end<blockquote>quote</blockquote>tail</article></body>", "Bare text é end\nquote\ntail"),
}


def test_pages(spark):
    rows = [(i, f"https://{name}.example.org/{i}", page, "x") for i, (name, (page, _)) in enumerate(PAGES.items())]
    df = spark.createDataFrame([*rows, rows[0], (99, None, PAGES["plain"][0], "x")], "page_id long, url string, html string, text string")
    want = sorted((i, p[1]) for i, p in enumerate(PAGES.values())) + [(0, PAGES["plain"][1]), (99, PAGES["plain"][1])]
    for size in (1 << 20, 0):
        got = html_extract.extract(df, broadcast_bytes=size).collect()
        assert sorted((r["id"], r["text"]) for r in got) == sorted(want)
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(df.where("false")).count() == 0


def test_template_text_goes_where_there_is_no_article(spark):
    page = lambda i: f"<body><div>Welcome to the site</div><div><p>Story number {i} is told.</p></div></body>"
    for n in (2, 3, 8):  # the same verdict however many pages the host has
        assert pages_of(spark, [page(i) for i in range(n)]) == [f"Story number {i} is told." for i in range(n)]
    copies = [page(1).replace("<body>", f"<body><div class=ad>Buy {k}</div>") for k in range(3)]
    both = "Welcome to the site\nStory number 1 is told."
    assert pages_of(spark, [page(1)]) == [both] and pages_of(spark, [page(1), page(1)]) == [both] * 2 and pages_of(spark, copies) == [both] * 3  # nothing tells template from text


def test_links_in_prose_stay_and_link_lists_go(spark):
    page = lambda i: f"<body><ul><li><a href=/>Home {i}</a><li><a href=/a>About {i}</a></ul><p>Intro line with <a href=/x>a long link that is most of the sentence {i}</a>.</p><p><a href=/s>Read <b>the</b> source {i}</a></p></body>"
    assert pages_of(spark, [page(i) for i in range(4)]) == [f"Intro line with a long link that is most of the sentence {i}.\nRead the source {i}" for i in range(4)]


def test_names_that_only_look_like_something_beside_the_text(spark):
    pages = ["<article class='search-article'><p>Found.</p></article>", "<article><div class='related-work'><p>Others did.</p></div><section class='notice-of-motion'><p>Moved.</p></section><div id='social-history'><p>Then.</p></div></article>",
             "<body><form id=aspnetForm><div class=sidebar>s</div><h1>T</h1><p>In a form.</p><input name=q></form></body>", "<body><form id=aspnetForm><p>Most of the text is in this form.</p></form><p>x</p></body>", "<body><p>A sentence before the form.</p><form><p>Your name</p></form></body>",
             "<article><p>x</p><article class='comment'><p>First!</p></article></article>"]
    want = ["Found.", "Others did.\nMoved.\nThen.", "T\nIn a form.", "Most of the text is in this form.\nx", "A sentence before the form.", "x"]
    rows = [(i, f"http://h{i}.net/x", p) for i, p in enumerate(pages)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in sorted(got, key=lambda r: r["id"])] == want


def test_forty_pages_of_two_layouts(spark):
    """Pages made of known blocks, with the text that each must give."""
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["ant", "bee", "cat", "dog", "eel", "fox"]) for _ in range(n))
    rows, want = [], []
    for i in range(40):
        framed, blocks, body = i % 2 == 0, [f"Title {i} {words(3)}"], ""
        for k in range(rng.randint(1, 6)):
            kind = rng.choice(["p", "link", "list", "table", "quote", "ref"])
            t, u = f"{words(rng.randint(3, 9))} {i}.{k}", words(2)
            if kind == "p":
                body, own = body + f"<p>{t} <b>{u}</b>\n  end</p>", [f"{t} {u} end"]
            elif kind == "link":
                body, own = body + f"<p>{t} <a href='/{k}'>{u}</a>, so.</p>", [f"{t} {u}, so."]
            elif kind == "list":
                body, own = body + f"<ul><li>{t}<li>{u} one</ul>", [t, f"{u} one"]
            elif kind == "table":
                body, own = body + f"<table><tr><td>{t}</td><td>{u}</td></tr></table>", [t, u]
            elif kind == "quote":
                body, own = body + f"<blockquote>{t}<br>{u}</blockquote>", [f"{t} {u}"]
            else:
                body, own = body + f"<p>{t} &amp; &lt;{u}&gt; &#8212;</p>", [f"{t} & <{u}> \u2014"]
            blocks += own
        menu = "".join(f"<li><a href='/{k}'>Item {k} {i}</a></li>" for k in range(3))
        box = f"<div class='ad'>Buy {i}</div><aside>Next {i}</aside><script>var a = '<p>no</p>'</script>"
        head = f"<html><head><title>Title {i}</title></head><body><div class=top>The Daily Page</div><ul class=m>{menu}</ul>"
        rows.append((i, f"http://{'a' if framed else 'b'}.net/{i}", f"{head}{box}<{'article' if framed else 'div'}><h1>{blocks[0]}</h1>{body}</{'article' if framed else 'div'}><div class=end>All rights reserved</div><section class=comments><p>Nice {i}</p></section></body></html>"))
        want.append("\n".join(blocks))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group in (64, 3):
        got = html_extract.extract(df, group=group).collect()
        assert [r["text"] for r in sorted(got, key=lambda r: r["id"])] == want


def as_pattern(wrapper):
    """A wrapper as a pattern over tokens that each end in a space."""
    out = []
    for unit in html_extract._units(wrapper):
        if unit.startswith("(") and unit[-2:] in (")?", ")+"):
            out.append(f"(?:{as_pattern(unit[1:-2])}){unit[-1]}")
        else:
            out.append(re.escape(unit + " "))
    return "".join(out)


@pytest.mark.parametrize("group", [64, 2])
def test_wrappers_cover_every_page(spark, group):
    rng = random.Random(6)
    blocks = ["<p>a</p>", "<p>b</p><p>c</p><p>d</p>", "<ul><li>x<li>y<li>z</ul>", "<h2>t</h2>", "<div>q<p>r</p></div>", "<table><tr><td>1<td>2</table>"]
    pages = [f"<body>{'<article>' if i % 3 else '<div>'}{''.join(rng.sample(blocks, rng.randint(1, 5)))}</body>" for i in range(30)]
    rows = [(i, "http://h.net/x", p) for i, p in enumerate(pages)]
    found = html_extract.wrappers(spark.createDataFrame(rows, "page_id long, url string, html string"), group=group).collect()
    assert {(r["framed"], r["n_pages"]) for r in found} == {(True, 20), (False, 10)}
    for page in pages:
        tokens, _, framed = html_extract._parse(page)
        plain = "".join(("#" if t[0] == "#" else t) + " " for t in tokens)
        assert re.fullmatch(as_pattern(next(r["wrapper"] for r in found if r["framed"] == framed)), plain)


def test_wrapper_folds_and_aligns():
    assert html_extract.fold("ul li # /li li # /li li # /li /ul".split()) == ["ul", "(li # /li)+", "/ul"]
    a = html_extract.fold("body h1 # /h1 p # /p p # /p /body".split())
    b = html_extract.fold("body h1 # /h1 div # /div p # /p p # /p /body".split())
    assert html_extract.align(a, b) == ["body", "h1", "#", "/h1", "(div)?", "(#)?", "(/div)?", "(p # /p)+", "/body"]


def pages_of(spark, pages):
    rows = [(i, "http://h.net/x", p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    both = [[r["text"] for r in sorted(html_extract.extract(df, broadcast_bytes=size).collect(), key=lambda r: r["id"])] for size in (1 << 20, -1)]
    assert both[0] == both[1]
    return both[0]


def test_an_article_on_one_page_leaves_the_others_of_its_host_whole(spark):
    pages = [f"<body><div class='content'><p>Story {i}.</p></div></body>" for i in range(6)] + ["<body><div>About</div><article><p>In it.</p></article></body>", "<div>x</div><article></article>"]
    assert pages_of(spark, pages) == [f"Story {i}." for i in range(6)] + ["In it.", "x"]


def test_slots_are_places_of_the_wrapper(spark):
    # one tag path for template, stories and links: only their places tell them apart
    def page(i):
        links = "".join(f"<li><a href='/{k}'>Link {k} {i}</a></li>" for k in range(2 + i % 3))
        optional = f"<h2>Update {i}</h2>" if i % 2 else ""
        return f"<body><div>Welcome</div><hr><h1>Title {i}</h1>{optional}<div>Story {i}.</div><ul class='a (b)'>{links}</ul><div>All rights</div></body>"

    want = ["\n".join([f"Title {i}", *([f"Update {i}"] if i % 2 else []), f"Story {i}."]) for i in range(12)]
    assert pages_of(spark, [page(i) for i in range(12)]) == want


def test_self_closed_elements_end_at_once():
    def text(page):
        page = f"<article><p>one</p>{page}<p>two</p></article>"
        tokens, events, framed = html_extract._parse(page)
        told = html_extract._slots(events, html_extract._stream(tokens)[2], framed)
        return html_extract.main_text(page, lambda name: [k for k, v in told.items() if v[0]])

    for empty in ('<svg class="i"/>', "<svg/>", "<svg hidden />", '<SVG class="i"><path d="M0"/><title>t</title></svg>', '<iframe src="/x"/>', "<object data='x' />", "<svg-icon name=x></svg-icon>", "<svg class=i/><title>t</title></svg>", "<object data=/x/y/>fallback</object>", "<iframe src = /x/>f</iframe>"):
        assert text(empty) == "one\ntwo", empty
    assert text("<svg " + "a=b/ " * 3000 + '"') and text("<svg " + "a=bcd/ " * 3000 + '"x"/>') == "one\ntwo"  # in linear time


def test_classed_heads_and_sections_inside_an_article_stay(spark):
    def page(i):
        related = "<div class=related><ul><li><a href=/a>Other story</a></ul></div>"
        alert = "<div class=alert>Prices may have changed.</div>"
        return f"<body><div class=site-header>Site</div><article><header class='entry-header'><h1>T{i}</h1></header><p>x{i}</p><div id='discussion'><p>We discuss {i}.</p></div><section class='search-methods'><p>We searched {i}.</p></section>{alert}{related}<section class='comments'>first!</section></article></body>"

    assert pages_of(spark, [page(i) for i in range(6)]) == [f"T{i}\nx{i}\nWe discuss {i}.\nWe searched {i}." for i in range(6)]
