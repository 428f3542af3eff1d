import pytest

from graphloom.llm import line_blocks as b

LONG = "Rivers carry stones from the hills down to the plain, where they settle in wide beds of gravel over many years."
PAGES = [
    ("", ""),
    ("just words", "just words"),
    (f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class=\"ad\">Buy now</div><article><h1>A &amp; B</h1><p><b>{LONG}<br><p>Short.</p></article><footer>&copy; x</footer></body></html>", f"A & B\n{LONG}\nShort."),
    (f"<body><article><p>{LONG}</p><p>End.</p></article><footer>&copy; cut &am", f"{LONG}\nEnd."),
    (f"<body><header><p>Site of many fine words that are long enough to be an article by themselves</p></header><div><p>{LONG}</p><p>x</p></div><div id='comments'><p>{LONG}</p></div></body>", f"{LONG}\nx"),
    (f"<main><p>{LONG}</p><aside><p>{LONG}</p></aside><form><p>q</p></form><p>  two\n words </p></main><p>{LONG}</p>", f"{LONG}\ntwo words"),
    (f"<p>{LONG}</p><script>var a = '</p><p>no';</script><style>p{{}}</style><!-- <p>no</p> --><p>yes</p>", f"{LONG}\nyes"),
    (f"<ul><li><a href=1>One link here</a><li><a href=2>Two links here</a></ul><p>{LONG}</p>", LONG),
    ("<article><p>Tiny.</p></article>", "Tiny."),
    ("<p title='a>b'>x &lt;y&gt; &#233;&nbsp;z</p>", "x <y> é z"),
    (f"<body><p class=notice>We use cookies on this site and you agree to all of them by reading on today ok</p><p>{LONG}</p>", LONG),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_pages(html, text):
    assert b.main_text(html) == text


def test_frame(spark):
    rows = [(i, "u", h, "x") for i, (h, _) in enumerate(PAGES)] + [(None, None, None, "x"), (0, "u", "", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = b.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == (PAGES[r.page_id][1] if r.page_id is not None else "") and r.n_chars == len(r.text)
    assert b.extract(df.limit(0)).count() == 0


def test_hostile_markup_is_linear():
    assert b.main_text("<p '" * 20_000) is not None
    assert b.main_text("<div>" * 50_000 + LONG) == LONG


WHOLE = [
    (f"<article><h2><a href='#x'>Section</a></h2><p>{LONG}</p><ul><li><a href=1>One source</a><li><a href=2>Two sources</a><li><a href=3>Three</a></ul><p>The end.</p></article>", f"Section\n{LONG}\nOne source\nTwo sources\nThree\nThe end."),
    (f"<div><h1>Title</h1></div><div class=share><a href=1>Post it</a></div><p>{LONG}</p><div class=ad>Buy</div><p>Short close.</p>", f"Title\n{LONG}\nShort close."),
    (f"<h1><a href=/>Title</a></h1><ul><li><a href=1>One link</a><li><a href=2>Two links</a><li><a href=3>More</a><li><a href=4>Most</a></ul><p>{LONG}</p><p><a href=5>A linked line</a></p><p>{LONG}</p>", f"Title\n{LONG}\nA linked line\n{LONG}"),
    (f"<p>Far away</p><nav>x</nav><nav>y</nav><p>{LONG}</p>", LONG),
]


@pytest.mark.parametrize("html,text", WHOLE)
def test_nothing_else_is_dropped(html, text):
    assert b.main_text(html) == text


ODD = [
    # optional end tags
    (f"<article><p>{LONG}</p><ul><li class='promo'>x<li>y</ul><p>rest</article>", f"{LONG}\ny\nrest"),
    (f"<article><p>{LONG}</p><dl><dt class=ad>x<dd>y</dl><table><tr><td class=ad>x<td>y<tr><td>z</table><p>rest</article>", f"{LONG}\ny\ny\nz\nrest"),
    (f"<article><p class=ad>x<p>{LONG}<div>y</div></article>", f"{LONG}\ny"),
    # links are measured on decoded text
    (f"<p>{LONG}</p><p>Q&amp;A with <a href=1>Q&amp;A&amp;B&amp;C&amp;D</a><p>Q&amp;A with <a href=1>Q&amp;A&amp;B&amp;C&amp;D</a>", f"{LONG}\nQ&A with Q&A&B&C&D\nQ&A with Q&A&B&C&D"),
    # a class word alone drops no article
    (f"<div class='comment-free review'><p>{LONG}</p></div>", LONG),
    (f"<div class='comment-box'><p>{LONG}</p></div>", LONG),
    (f"<body><form id=aspnet><nav>Home</nav><p>{LONG}</p></form></body>", LONG),
    (f"<article class='no-sidebar'><div class=header><h1>T</h1></div><p>{LONG}</p></article>", f"T\n{LONG}"),
    # no article mark: short lines outside running text are beyond surge and dive
    (f"<div>Home - News</div><h1>Title</h1><p>{LONG}</p><div>Photo</div><p>{LONG}</p><div>menu</div>", f"Title\n{LONG}\nPhoto\n{LONG}"),
    ("<div>Hello there</div>", "Hello there"),
    (f"<div><div>{LONG}</div></div><div>imprint</div>", f"{LONG}\nimprint"),
    (f"<h1>T</h1><p>{LONG} <span class=ad>Buy</span>now</p><div style='display: none'><p>{LONG}</p></div><p hidden>{LONG}</p>", f"T\n{LONG} now"),
    (f"<article><p>{LONG}</p><section class=comments><article><p>{LONG}</p></article></section></article>", LONG),
]


@pytest.mark.parametrize("html,text", ODD)
def test_odd_markup(html, text):
    assert b.main_text(html) == text


def plain_choice(weights, heading):
    """The kept line numbers by plain loops: a line is in a stretch if some window has a positive sum on both sides of it."""
    n, w, limit = len(weights), b.WINDOW, b.SURGE
    positive = [i for i in range(n) if weights[i] > 0]
    runs = []
    for i in positive:  # runs of positive lines less than a window apart
        if runs and i - runs[-1][-1] <= w:
            runs[-1].append(i)
        else:
            runs.append([i])
    if not runs:
        return []
    peak = [max(sum(weights[j] for j in range(s, s + w) if 0 <= j < n) for s in range(r[0] - w + 1, r[-1] + 1)) for r in runs]
    if max(peak) < limit:
        best = max(runs, key=lambda r: sum(weights[i] for i in r))
        return list(range(best[0], best[-1] + 1))
    kept = []
    for k, r in enumerate(runs):
        own = range(r[0], r[-1] + 1)
        ok = peak[k] >= limit
        for other in (k - 1, k + 1):
            if 0 <= other < len(runs) and peak[other] >= limit:
                gap = (r[0] - runs[other][-1] if other < k else runs[other][0] - r[-1]) - 1
                ok = ok or gap <= w or any(heading[i] for i in own)
        kept += own if ok else []
    return kept


def test_distribution_against_plain_loops():
    import random

    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randint(0, 30)
        weights = [rng.choice([0, 0, 0, rng.randint(1, 120), rng.randint(1, 30)]) for _ in range(n)]
        heading = [w > 0 and rng.random() < 0.1 for w in weights]
        found = b.stretches(weights)
        got = [i for x, y in (b.chosen(found, weights, heading) if found else []) for i in range(x, y)]
        assert got == plain_choice(weights, heading)


def test_deep_and_wide_markup_is_linear():
    assert b.main_text("<ul><li>" + "<div>" * 20_000 + "<li>x" * 20_000 + f"<p>{LONG}") is not None
    assert b.main_text("<span class=ad>" * 20_000 + "</span>" * 20_000 + f"<p>{LONG}") == LONG
    assert b.main_text("<p>" + "word " * 400_000 + "</p>") == ("word " * 400_000).strip()
