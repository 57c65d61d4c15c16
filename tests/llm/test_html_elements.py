"""All kinds of elements of an article in every wrapper, and whole pages labelled by hand."""

import difflib

import pytest

from lodestone.llm import html_blocks as H
from lodestone.llm._shared import prepare

P = "An ordinary paragraph of the article that says a few things about its subject, at some length, and ends."
ELEMENTS = {
    "table": ("<table><tr><th>Year</th><th>Count</th></tr><tr><td>1999</td><td>12 birds</td></tr><tr><td>2004</td><td>30 birds</td></tr></table>", ["Year", "Count", "1999", "12 birds", "2004", "30 birds"]),
    "dl": ("<dl><dt>Heron</dt><dd>A tall bird that waits in shallow water.</dd><dt>Wren</dt><dd>A small one.</dd></dl>", ["Heron", "A tall bird that waits in shallow water.", "Wren", "A small one."]),
    "figcaption": ('<figure><img src="a.png"><figcaption>The lake in early spring</figcaption></figure>', ["The lake in early spring"]),
    "links": ('<ul><li><a href="/a">A history of the lake</a></li><li><a href="/b">Birds of the north shore</a></li><li><a href="/c">Maps</a></li></ul>', ["A history of the lake", "Birds of the north shore", "Maps"]),
    "pre": ("<pre>count = 0\nfor bird in lake:\n  count += 1</pre>", ["count = 0 for bird in lake: count += 1"]),
    "ol": ("<ol><li>Walk to the shore.</li><li>Wait.</li><li>Count what you see.</li></ol>", ["Walk to the shore.", "Wait.", "Count what you see."]),
}
WRAPPERS = {"article": ("<article>", "</article>"), "main": ("<main>", "</main>"), "content": ('<div class="content">', "</div>"), "div": ("<div>", "</div>")}
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/x">Topics</a></li><li><a href="/y">About</a></li></ul></nav>'
FOOT = "<footer><p>© 2024 The Lake Society. All rights reserved.</p></footer>"
ASIDE = '<aside class="related"><h3>Related</h3><ul><li><a href="/1">Another story</a></li><li><a href="/2">More birds</a></li></ul></aside>'


@pytest.fixture(scope="module")
def model():
    return H.train()


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("element", ELEMENTS)
def test_no_block_of_an_article_is_lost(model, wrapper, element):
    html, parts = ELEMENTS[element]
    open_, close = WRAPPERS[wrapper]
    for before, after in (("", ""), (NAV, FOOT), (NAV, ASIDE + FOOT)):
        page = f"<html><body>{before}{open_}<h1>Birds of the lake</h1><p>{P}</p>{html}<p>{P}</p>{close}{after}</body></html>"
        assert H.main_texts(model, [page])[0].split("\n\n") == ["Birds of the lake", P, *parts, P]


SITE = '<header class="masthead"><a href="/">The Lake Society</a></header>'
COOKIES = '<div class="cookie-notice"><p>We use cookies to improve this site.</p><button>Accept all</button></div>'
COMMENTS = '<div id="comments"><h3>Comments</h3><p>Great article, thanks!</p><p>I do not agree at all.</p></div>'
SHARE = '<div class="share"><a href="#">Tweet</a> <a href="#">Share this</a></div>'
#: (page, its main text), by hand.
PAGES = [
    (f"{SITE}{NAV}<article><h1>Counting herons</h1><p>Every spring we count the herons of the lake, from the reeds to the north shore.</p><p>This year there were thirty.</p></article>{FOOT}", "Counting herons\n\nEvery spring we count the herons of the lake, from the reeds to the north shore.\n\nThis year there were thirty."),
    (f"{COOKIES}{NAV}<main><h1>Soup of leeks</h1><p>A soup for four people.</p><table><tr><th>What</th><th>How much</th></tr><tr><td>Leeks</td><td>three</td></tr></table><ol><li>Cut the leeks.</li><li>Boil them for an hour.</li></ol></main>{ASIDE}{FOOT}", "Soup of leeks\n\nA soup for four people.\n\nWhat\n\nHow much\n\nLeeks\n\nthree\n\nCut the leeks.\n\nBoil them for an hour."),
    (f'{NAV}<div class="post"><h2>On the night train</h2><p>We left at nine. The carriage was empty but for a man with a cello.</p><blockquote>He played until the border.</blockquote><p>Nobody slept.</p>{SHARE}</div>{COMMENTS}{FOOT}', "On the night train\n\nWe left at nine. The carriage was empty but for a man with a cello.\n\nHe played until the border.\n\nNobody slept."),
    (f'{NAV}<article><h1>Installing the pump</h1><p>Shut the valve before you begin, and keep a bucket at hand.</p><pre><code>pump --install\npump --test</code></pre><p>The light turns green when the pump runs.</p></article>{COMMENTS}{FOOT}', "Installing the pump\n\nShut the valve before you begin, and keep a bucket at hand.\n\npump --install pump --test\n\nThe light turns green when the pump runs."),
    (f'{SITE}<div id="content"><h1>Words of the lake</h1><dl><dt>Reed</dt><dd>A tall grass at the water.</dd><dt>Mere</dt><dd>A shallow lake.</dd></dl></div>{FOOT}', "Words of the lake\n\nReed\n\nA tall grass at the water.\n\nMere\n\nA shallow lake."),
    (f'<div class="ad"><p>Buy now and save!</p></div>{NAV}<main><h1>Ice on the north shore</h1><figure><img src="i.png"><figcaption>The shore in January</figcaption></figure><p>The ice came late and went early, the wardens say.</p></main><div class="sidebar"><p>Popular stories</p></div>{FOOT}', "Ice on the north shore\n\nThe shore in January\n\nThe ice came late and went early, the wardens say."),
    (f"{NAV}<div><h1>A short history</h1><p>The village was built in 1620 around a mill that stood until the flood.</p><h2>The flood</h2><p>It took the mill and the bridge.</p></div>{FOOT}", "A short history\n\nThe village was built in 1620 around a mill that stood until the flood.\n\nThe flood\n\nIt took the mill and the bridge."),
    (f"{SITE}{NAV}<article><h1>Questions</h1><details><summary>Is the path open?</summary><p>It is open from March to the end of October.</p></details><section><h3>Dogs</h3><p>On a leash.</p></section></article>{FOOT}", "Questions\n\nIs the path open?\n\nIt is open from March to the end of October.\n\nDogs\n\nOn a leash."),
    (f'<form class="search"><label>Search</label><input name="q"></form>{NAV}<article><h1>Das Wetter</h1><p>Am Morgen Nebel, am Nachmittag Sonne &amp; Wind aus Südwest.</p><ul><li>Höchstwert: 21 Grad</li><li>Tiefstwert: 9 Grad</li></ul></article><div class="newsletter"><p>Subscribe to our newsletter</p></div>{FOOT}', "Das Wetter\n\nAm Morgen Nebel, am Nachmittag Sonne & Wind aus Südwest.\n\nHöchstwert: 21 Grad\n\nTiefstwert: 9 Grad"),
    (f"{NAV}<main><p>No heading here. Only a text that goes on for a while, as letters do, and that ends without a signature.</p><p>A second part follows, shorter.</p></main>{SHARE}{FOOT}", "No heading here. Only a text that goes on for a while, as letters do, and that ends without a signature.\n\nA second part follows, shorter."),
    (f"{NAV}{FOOT}", ""),
]


def test_pages_labelled_by_hand(model):
    right = total = 0
    for page, want in PAGES:
        got = H.main_texts(model, [f"<html><head><title>T</title></head><body>{page}</body></html>"])[0]
        same = sum(m.size for m in difflib.SequenceMatcher(None, got, want, autojunk=False).get_matching_blocks())
        right += same
        total += max(len(got), len(want))
    assert right / total >= 0.98


def test_weights_are_kept(spark, model, monkeypatch):
    prepare(spark)
    first = H.weights(spark)
    monkeypatch.setattr(H, "train", lambda: 1 / 0)
    again = H.weights(spark)
    assert all((a == b).all() and (a == c).all() for a, b, c in zip(first, again, model, strict=True))
