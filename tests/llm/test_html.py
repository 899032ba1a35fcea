"""Main text of pages: what is kept, what is left out, and broken markup."""

import math
import random

import numpy as np
import pytest

from pairmatch.llm import html
from pairmatch.llm.html import ARTICLE_FACTOR, ARTICLE_LEAST, REGION_SHARE, content_regions, extract_main_text, main_text, smooth

LONG = "This paragraph carries the story on with enough words to count as running text, no doubt."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";x(0);</script></head><body class="has-sidebar">
<header><h1>Site</h1><nav><ul><li><a href="/a">Menu</a></li></ul></nav></header><div class="cookie-notice">We use cookies. {LONG}</div>
<div class="ad">Buy now! {LONG}</div><article><header><h1>Ti&amp;tle&nbsp;x</h1></header><p><b>Lead <i>in</i>.<br>next<p>{LONG}</p>
<p>Short.</p><div class="ad-slot"><p>{LONG} advert</p></div><form><p>{LONG} form</p></form><ul><li>one<li>two</ul><p>5 &lt; 6 &#233;</p>
<section id="comments"><p>{LONG} reply</p></section></article><aside><p>{LONG} aside</p></aside><footer>&copy; x</footer></body></html>"""


def test_page():
    assert main_text(PAGE) == f"Ti&tle x\nLead in. next\n{LONG}\nShort.\none\ntwo\n5 < 6 é"


def test_truncated_and_broken():
    assert main_text(f"<article><p>{LONG}<p>More {LONG}") == f"{LONG}\nMore {LONG}"
    assert main_text(f"<nav><ul><li>Menu<article><p>{LONG}</article>") == LONG
    assert main_text("<div>" * 3000 + f"<p>{LONG}</p></b></i>") == LONG
    assert main_text("<p>unclosed <script>var x = '<p>no</p>'") == "unclosed"


def test_nothing():
    for h in (None, "", " ", "<html><body></body></html>", "<nav><a href='/'>Home</a></nav>", "<!-- c -->"):
        assert main_text(h) == ""


def test_without_article():
    page = f"<body><div id='menu'><a href='/'>Home</a></div><div><ul><li><a href='a'>A link</a><li><a href='b'>Other link</a></ul></div><div class='content'><h2>Head</h2><p>{LONG}</p><p>End.</p></div></body>"
    assert main_text(page) == f"Head\n{LONG}\nEnd."


def test_smoothing_keeps_constants():
    assert np.allclose(smooth(np.full(7, 3.0), 1.0), 3.0)


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (None, None, None, "x"), (1, "u", PAGE, "x"), (2, "v", "<p>" + "word " * 50000 + "</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract_main_text(df).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in out) == sorted([("1", len(main_text(PAGE)))] * 2 + [("None", 0), ("2", 249999)])
    assert all(r.n_chars == len(r.text) for r in out)
    assert extract_main_text(df.limit(0)).collect() == []


NAV = "".join(f"<li><a href='/{i}'>Section {i}</a></li>" for i in range(6))
STORY = [f"{LONG} Part {i}." for i in range(5)]
NEUTRAL = f"""<html><body><div class='c1'><div class='c2'><ul>{NAV}</ul></div><div class='c3'>Call now, only today.</div>
<div class='c4'><h2>Head line</h2>{''.join(f'<p>{s}</p>' for s in STORY)}<p>Short.</p></div>
<div class='c5'><span>More</span> <span>of</span> <span>this</span> <b>soon</b></div><div class='c6'>Copyright by someone</div></div></body></html>"""


def test_classes_that_say_nothing(monkeypatch):
    """The ratios alone find the story; without them every line stays."""
    want = "\n".join(["Head line", *STORY, "Short."])
    assert main_text(NEUTRAL) == want
    monkeypatch.setattr(html, "content_regions", lambda lines, *a: {r for _, _, _, r in lines})
    everything = main_text(NEUTRAL)
    assert everything != want and "Call now, only today." in everything and "Section 3" in everything


def test_adverts_go_by_ratio():
    """An advert of a few sentences outside the article goes whatever it is called, even beside a tiny article."""
    for name in ("ad", "x", "promo"):
        page = f"<body><div class='{name}'>Buy this fine thing today, it is the best of all things.</div><article><p>Tiny one.</p></article></body>"
        assert main_text(page) == "Tiny one."
    # an article element that only teases does not hide the text beside it
    assert main_text(f"<article><p>Teaser.</p></article><div>{''.join(f'<p>{s}</p>' for s in STORY)}</div>").endswith(STORY[-1])


def brute(lines, articles, sigma, share):
    """Regions by plain loops over lines and their neighbours."""
    n = len(lines)
    raw = [len(t) / k for t, k, _, _ in lines]
    reach = max(1, round(3 * sigma))
    smoothed = []
    for i in range(n):
        near = [(math.exp(-0.5 * ((j - i) / sigma) ** 2), raw[j]) for j in range(max(0, i - reach), min(n, i + reach + 1))]
        smoothed.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    mean = sum(smoothed) / n
    limit = min(math.sqrt(sum((x - mean) ** 2 for x in smoothed) / n), max(smoothed))
    prose = {}
    for r in {line[3] for line in lines}:
        own = [(line, x) for line, x in zip(lines, smoothed) if line[3] == r]
        text, weight = sum(len(line[0]) for line, _ in own), sum(len(line[0]) for line, x in own if x >= limit * (1 - 1e-12))
        if weight and sum(line[2] for line, _ in own) <= share * text:
            prose[r] = (weight, text)
    main = max((t for r, (_, t) in prose.items() if r in articles), default=0)
    bar = max(ARTICLE_FACTOR * main, ARTICLE_LEAST) if main else REGION_SHARE * max((w for w, _ in prose.values()), default=0)
    return {r for r, (w, _) in prose.items() if r in articles or w >= bar}


@pytest.mark.parametrize("sigma", [0.7, 1.0, 2.5])
def test_regions_against_brute_force(sigma):
    rng = random.Random(9)
    for _ in range(400):
        lines = [("x" * rng.choice([1, 5, 30, 200, 900]), rng.randint(1, 9), 0, rng.randint(1, 5)) for _ in range(rng.randint(1, 25))]
        lines = [(t, k, rng.choice([0, 0, len(t)]), r) for t, k, _, r in lines]
        articles = {r for r in range(1, 6) if rng.random() < 0.2}
        assert content_regions(lines, articles, sigma, 0.5) == brute(lines, articles, sigma, 0.5)
