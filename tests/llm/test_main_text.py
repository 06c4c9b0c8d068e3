import pytest

from quire.llm import main_text as H
from tests.llm.common import clash

LONG = "The cat sat on the mat and the dog was in the house with the bird for a long time that day. "
CASES = [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("a < b", "a < b"),
    ("<p>a<b>b</b>c &nbsp; d<br>e</p>", "abc d e"),
    (f"<nav><p>Home</nav><article><h1>T</h1><p>{LONG}<p>Short<aside>x</aside></article><footer>f</footer>",
     f"T {LONG.strip()} Short"),
    (f"<div class='cookie-notice'>{LONG}</div><div><p>{LONG}</p></div><div id=comments><p>{LONG}</p></div>", LONG.strip()),
    (f"<article><header><h1>T</h1><span>by me</span></header><p>{LONG}</p><form><p>mail</p></form></article>",
     f"T {LONG.strip()}"),
    (f"<body><script>var a='<p>{LONG}</p>';</script><style>p{{}}</style><!-- <p>c</p> --><p>{LONG}</p></body>", LONG.strip()),
    (f"<div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><p>{LONG}</p>", LONG.strip()),
    (f"<p>{LONG}</p><p>Short in between</p><p>{LONG}</p>", f"{LONG.strip()} Short in between {LONG.strip()}"),
    (f"<div hidden><p>{LONG}</p></div><div role='banner'>b</div><p>{LONG}</p>", LONG.strip()),
    ("<article><p>Xyzzy plugh frobnicate quux grault garply waldo fred xyzzy plugh thud corge blorp snork</p></article>",
     "Xyzzy plugh frobnicate quux grault garply waldo fred xyzzy plugh thud corge blorp snork"),
    (f"<article><p>{LONG}</p><ul><li>First point</li><li>Second <a href=x>linked</a> point</li></ul>"
     f"<p>See <a href=y>this whole linked sentence</a>.</p><p>{LONG}</p></article>",
     f"{LONG.strip()} First point Second linked point See this whole linked sentence. {LONG.strip()}"),
    (f"<div class='post-content related-posts-enabled'><p>{LONG}</p></div>", LONG.strip()),
    (f"<article><div class='market-share'><p>{LONG}</p></div></article>", LONG.strip()),
    (f"<div class='site-footer'><p>{LONG}</p></div><div id='adSlot_2'><p>{LONG}</p></div><p>{LONG}</p>", LONG.strip()),
    (f"<div class='modal'><main><p>{LONG}</p></main></div>", LONG.strip()),
    ("<p title='a > b'>x</p>", "x"), ("<ul><li class=ad>x<li>y</ul>", "y"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert H.main_text(page) == text


def test_hostile_pages_end():
    for p in ("<div>" * 50000 + "x", "<" * 100000, "<a " * 50000, "<!--" * 20000, "&" * 100000, "<p class='" + "a" * 100000,
              "<nav>" * 20000 + "x", "</div>" * 50000 + "x"):
        H.main_text(p)


def test_query_over_table(spark):
    df = spark.createDataFrame([(i, f"u{i}", p) for i, (p, _) in enumerate(CASES)], "page_id long, url string, html string")
    got = sorted(H.extract_main_text(clash(df)).collect(), key=lambda r: r.page_id)
    assert [(r.text, r.n_chars) for r in got] == [(t, len(t)) for _, t in CASES]
    assert H.extract_main_text(df.limit(0)).count() == 0


def test_generated_pages():
    """Articles of known text, some words of it linked, between boilerplate of many kinds."""
    import random
    r = random.Random(11)
    words = "the of and storm river house stone garden winter in on a with old new letters music road".split()
    boiler = ["<nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav>", f"<div class='cookie-banner'>{LONG}</div>",
              f"<aside><p>{LONG}</p></aside>", f"<div id=sidebar><p>{LONG}</p></div>", "<footer>All rights reserved</footer>",
              f"<section class='comments-list'><p>{LONG}</p></section>", f"<form><p>{LONG}</p></form>",
              f"<div class='ad-slot'><p>{LONG}</p></div>", f"<script>document.write('<p>{LONG}</p>')</script>"]
    for _ in range(300):
        want, inside = [], []
        for _ in range(r.randint(1, 6)):
            sentence = [r.choice(words) for _ in range(r.randint(3, 60))]
            want.append(" ".join(sentence))
            k = r.randint(0, len(sentence) - 1)
            linked = [f"<a href=z>{w}</a>" if j == k and r.random() < 0.5 else w for j, w in enumerate(sentence)]
            tag = r.choice(["p", "li", "blockquote", "div class='market-share x9'"])
            inside.append(f"<{tag}>{' '.join(linked)}</{tag.split()[0]}>")
        before, after = r.sample(boiler, 3), r.sample(boiler, 3)
        page = f"<html><body>{''.join(before)}<article class='post has-sidebar'>{''.join(inside)}</article>{''.join(after)}</body></html>"
        assert H.main_text(page) == " ".join(want), page
