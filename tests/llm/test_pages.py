"""Main text of pages written by hand, in makes that the labelled pages do not have, with the text that a reader would mark.

The page laid out by a table shows what the model does not know yet: its menu and its advert, plain cells, are taken for text (README).
"""

from braidframe.llm import html_crf

RECIPE = """<!doctype html><html lang="en"><head><title>Plum cake</title><style>.x{color:red}</style></head><body>
<div id="topbar"><a href="/">Home</a> <a href="/r">Recipes</a> <a href="/a">About us</a></div>
<main><h1>Plum cake with a crumble top</h1>
<p>Ripe plums need little sugar, and a crumble of butter and oats keeps the fruit from drying out while the cake rises slowly in the oven.</p>
<p>Halve the fruit, take out the stones &amp; lay the halves on the dough with the cut side up, close together, so that no juice runs between them.</p>
<p>Bake for fifty minutes at a middling heat, let the cake rest in its tin for a quarter of an hour, and serve it while it is still warm.</p></main>
<div class="sidebar"><h3>More recipes</h3><ul><li><a href="1">Apple pie</a></li><li><a href="2">Pear tart</a></li><li><a href="3">Cherry loaf</a></li></ul></div>
<form action="/s"><label>Your e-mail</label><input name="e"><button>Subscribe</button></form>
<footer><p>&copy; 2024 Kitchen Notes. All rights reserved.</p><a href="/p">Privacy</a></footer>
<script>track("cake")</script></body></html>"""

REPORT = """<html><body><table width="100%"><tr><td class="nav"><a href="a">News</a> | <a href="b">Sport</a> | <a href="c">Weather</a></td></tr>
<tr><td><div class="article-body"><h2>Bridge over the Arn opens after three years</h2>
<p>The new bridge over the river Arn was opened on Tuesday morning, three years after the old one had been closed to lorries because of cracks in its piers.</p>
<p>Engineers said that the steel deck, which was floated into place in two halves last autumn, would carry twice the traffic of the stone arch that it replaces.</p>
<p>People who live near the northern bank had complained for months about the detour through the village, where lorries had damaged walls and a well.</p></div></td></tr>
<tr><td class="ad">Advertisement: buy two pairs of boots and get the third one free</td></tr>
<tr><td class="comments"><h4>Comments</h4><div class="comment"><b>walker77</b> finally!</div><div class="comment"><b>anna</b> about time they did it</div></td></tr></table>
<div class="cookie-banner">We use cookies to improve this site. <button>Accept all</button></div></body></html>"""

WANT = {
    1: [
        "Plum cake with a crumble top",
        "Ripe plums need little sugar, and a crumble of butter and oats keeps the fruit from drying out while the cake rises slowly in the oven.",
        "Halve the fruit, take out the stones & lay the halves on the dough with the cut side up, close together, so that no juice runs between them.",
        "Bake for fifty minutes at a middling heat, let the cake rest in its tin for a quarter of an hour, and serve it while it is still warm.",
    ],
    2: [
        "Bridge over the Arn opens after three years",
        "The new bridge over the river Arn was opened on Tuesday morning, three years after the old one had been closed to lorries because of cracks in its piers.",
        "Engineers said that the steel deck, which was floated into place in two halves last autumn, would carry twice the traffic of the stone arch that it replaces.",
        "People who live near the northern bank had complained for months about the detour through the village, where lorries had damaged walls and a well.",
    ],
}
#: What is kept of the second page and should not be, as measured.
KNOWN_MISTAKES = {"News | Sport | Weather", "Advertisement: buy two pairs of boots and get the third one free"}


def test_pages_of_other_makes(spark):
    d = spark.createDataFrame([(1, "u1", RECIPE), (2, "u2", REPORT), (3, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_crf.extracted(d).collect()}
    assert got[1].text.split("\n") == WANT[1]
    blocks = got[2].text.split("\n")
    assert [x for x in blocks if x in WANT[2]] == WANT[2]
    assert {x for x in blocks if x not in WANT[2]} <= KNOWN_MISTAKES
    assert (got[3].text, got[3].n_chars) == ("", 0)
    assert html_crf.extracted(d.limit(0)).count() == 0
