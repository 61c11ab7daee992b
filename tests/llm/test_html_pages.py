"""The block labeller on pages written by hand, on hostile pages, and its path vectors against plain sums."""

import time

import numpy as np
import pytest

from corpusloom.llm import html, html_training

#: Pages written by hand, unlike those of the training, with the text that they should give.
BY_HAND = {
    "div-only": ("<html><body><div><div>My Site</div><div><a href='/'>Home</a> <a href='/a'>About</a> <a href='/c'>Contact</a></div><div><h2>How we measure rain</h2><div>Rain is caught in a funnel and led into a narrow tube, where a scale shows the depth in millimetres.</div><div>The tube is emptied every morning at seven, and the reading is entered in a book that goes back to 1871.</div></div><div>&copy; 2019 My Site. All rights reserved.</div></div></body></html>",
     "How we measure rain Rain is caught in a funnel and led into a narrow tube, where a scale shows the depth in millimetres. The tube is emptied every morning at seven, and the reading is entered in a book that goes back to 1871."),
    "table": ("<html><head><title>x</title></head><body bgcolor=white><table border=0><tr><td width=120><a href=index.html>Index</a><br><a href=links.html>Links</a><br><a href=mail.html>Mail me</a></td><td><h1>Growing tomatoes</h1><font size=2>Sow the seeds in March, in a warm place with much light.</font><br><br><font size=2>Plant them out in May, once the last frost is over.</font></td></tr><tr><td colspan=2>Copyright 1999 J. Smith</td></tr></table></body></html>",
     "Growing tomatoes Sow the seeds in March, in a warm place with much light. Plant them out in May, once the last frost is over."),
    "no tags": ("The ferry leaves at nine. It takes two hours to cross, and there is a small bar on board.", "The ferry leaves at nine. It takes two hours to cross, and there is a small bar on board."),
    "blog": ('<!doctype html><html><body class="home blog"><header id="masthead"><a class="logo" href="/">Field Notes</a><nav class="main-nav"><ul><li><a href="/">Home</a><li><a href="/about">About</a></ul></nav></header><main><article class="post hentry"><h1 class="entry-title">A week in the hills</h1><p class="byline">By Ann Lee</p><div class="entry-content"><p>We set out on Monday with too much food and too few maps.</p><p>By <a href="/x">Wednesday</a> it was the other way round.</p><aside class="ad">Buy boots now! <a href="/shop">Shop</a></aside><blockquote>Never trust a dotted line.</blockquote><ul><li>one tent</li><li>two stoves</li></ul></div></article><section id="comments"><h3>2 Comments</h3><div class="comment"><b>Bob</b> says: <p>Lovely pictures!</p></div></section></main><aside class="sidebar widget"><h3>Recent posts</h3><ul><li><a href="/1">Rain</a></li></ul></aside><form class="newsletter"><label>Email</label><input><button>Subscribe</button></form><footer class="site-footer">&copy; 2021 Field Notes</footer></body></html>',
     "A week in the hills By Ann Lee We set out on Monday with too much food and too few maps. By Wednesday it was the other way round. Never trust a dotted line. one tent two stoves"),
    "hidden": ('<body><div class="cookie-notice" style="display:none">We use cookies to improve your experience. <button>Accept</button></div><div id="content"><h1>Bridge reopens</h1><p>The old bridge over the Elm reopened on Friday after two years of work.</p><div style="display:none">Share this story with friends and family today.</div><p>Traffic was light in the first hours.</p></div><div class="footer"><p>Contact us</p><p>Terms of use</p></div></body>',
     "Bridge reopens The old bridge over the Elm reopened on Friday after two years of work. Traffic was light in the first hours."),
    "news": ('<body><div class="top-banner">Subscribe today and get 50% off</div><div class="navbar"><a href="/w">World</a><a href="/s">Sport</a></div><div class="story-body"><h1>Council votes on park</h1><p>The council voted nine to four on Tuesday to keep the park open at night.</p><p>Lamps will be added along the river path next spring, the mayor said.</p><div class="related-links"><h4>Related</h4><ul><li><a href="/a">Lamps dimmed in old town</a></li></ul></div><p>Residents had asked for them for years.</p></div><div class="comments"><p>Good news at last!</p></div><div id="footer">About us | Careers | Privacy</div></body>',
     "Council votes on park The council voted nine to four on Tuesday to keep the park open at night. Lamps will be added along the river path next spring, the mayor said. Residents had asked for them for years."),
    "docs": ('<body><nav class="toc"><ul><li><a href="#i">Install</a></li><li><a href="#u">Use</a></li></ul></nav><main><h1>Install</h1><p>Run the installer and follow the steps.</p><pre>make install</pre><table><tr><th>Key</th><td>Meaning</td></tr><tr><th>-v</th><td>more output</td></tr></table></main><footer><p>Built with care</p></footer></body>',
     "Install Run the installer and follow the steps. make install Key Meaning -v more output"),
}


@pytest.mark.parametrize("name", BY_HAND)
def test_by_hand(name):
    page, wanted = BY_HAND[name]
    blocks = html.read_blocks(page)
    odds = html.Labeller.load().scores([blocks])[0]
    assert " ".join(b.text for b, x in zip(blocks, odds, strict=True) if x > 0) == wanted


@pytest.mark.parametrize(("page", "n"), [("<p>a" * 100_000, 100_000), ("<div>a" * 30_000, 30_000), ("<p>" + "word other " * 100_000, 1), ("<a href=x>b" * 50_000, 1), ('<p class="' + "part " * 50_000 + '">x', 1)])
def test_hostile_pages(page, n):
    """A page of many, deep or long blocks goes alone and in linear time; the small pages beside it are not padded to it."""
    began = time.perf_counter()
    blocks = html.read_blocks(page)
    scores = html.Labeller.load().scores([blocks, *[html.read_blocks("<p>x<p>y")] * 63])
    assert len(blocks) == n and [len(s) for s in scores] == [n] + [2] * 63
    assert time.perf_counter() - began < 90


def test_every_word_counts():
    table = np.random.default_rng(1).normal(size=(html.WORD_BUCKETS, 4)).astype(np.float32)
    words = [f"w{i}" for i in range(2000)]
    long, short = html.word_buckets(" ".join(words)), html.word_buckets("a b")
    got = html.bag_means(table, [long, short])
    assert len(long) == 2000 and np.allclose(got[0], table[list(long)].sum(0) / 2000**0.5, atol=1e-4) and np.allclose(got[1], table[list(short)].sum(0) / 2**0.5, atol=1e-6)


def test_path_vectors():
    table = np.random.default_rng(2).normal(size=(html.PATH_BUCKETS, 4)).astype(np.float32)
    for seed in range(40):
        blocks = html.read_blocks(html_training.Maker(seed).page())
        assert np.allclose(html.path_means(table, blocks), html.bag_means(table, [html.path_buckets(b.path) or (0,) for b in blocks]), atol=1e-5)


def test_hidden_is_a_mark():
    for attribute in ("hidden", 'style="display:none"', "style='Visibility: hidden'", 'aria-hidden="true"'):
        assert "@hidden" in html.read_blocks(f"<div {attribute}>x")[0].path.marks
    assert "@hidden" not in html.read_blocks('<div style="color:red" aria-hidden="false">x')[0].path.marks
