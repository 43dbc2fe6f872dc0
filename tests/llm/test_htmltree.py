import math
from collections import defaultdict

import pytest

from strandline.llm import htmltree as h

PAGE = """<!DOCTYPE html><html><head><title>x</title></head><body><div id="cookie-notice">We use cookies</div><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
<div><article class="post"><h1>Title &amp; more</h1><p>One <b>bold</b>
 text&nbsp;x<br>line two<p>Two &lt;p&gt;<ul><li>a<li>b</ul><div class="ad-slot">Buy</div><script>if(a<b)"</p>"</script><table><tr><td>c1<td>c2</table></article><aside>rel</aside></div>
<section id="comments"><p>great post</p></section><form><p>Mail <input></p></form><footer>&copy; x</footer></body></html>"""
TEXT = "Title & more\nOne bold text x line two\nTwo <p>\na\nb\nc1\nc2"


def test_article_without_boilerplate():
    assert "\n".join(h.kept_blocks(PAGE, "h", set())) == TEXT


def test_repeated_branches_without_names_go(spark):
    pages = [(k, f"http://a.example/{k}", f"<html><body><div>Welcome to our site</div><div><p>Story number {k} begins</p><p>and goes on {k * k}</p></div><div>All about us</div></body></html>") for k in range(12)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story number 3 begins\nand goes on 9"


def test_joined_by_host_gives_the_same(spark, monkeypatch):
    pages = [(k, f"http://{'ab'[k % 2]}.example/{k}", f"<body><div>Same on all</div><div><p>Text {k}</p></div></body>") for k in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = sorted(map(tuple, h.extract(df).collect()))
    monkeypatch.setattr(h, "BROADCAST_KEYS", -1)
    assert sorted(map(tuple, h.extract(df).collect())) == want


def test_odd_rows(spark):
    pages = [(1, None, None), (2, "http://x.example", ""), (3, "nonsense", "plain text"), (4, "http://x.example", "<p>unclosed <b>tag"), (4, "http://x.example", "<p>unclosed <b>tag"), (None, "http://y.example", PAGE), (5, "http://z.example", "<p>" + "long " * 20000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'old' as text", "1 as host", "2 as path")
    got = h.extract(df).collect()
    assert len(got) == 7
    by = {r.page_id: r.text for r in got}
    assert by[1] == "" and by[2] == "" and by[3] == "plain text" and by[4] == "unclosed tag" and by[None] == TEXT and len(by[5]) == 99999
    assert h.extract(df.limit(0)).count() == 0


def test_hosts():
    assert [h.host_of(u) for u in ("https://U:p@Ab.Example:80/x", "x", None, "ftp://q?y")] == ["ab.example", "", "", "q"]


def test_marked_pages_are_judged_by_importance(spark):
    pages = [
        (k, f"http://a.example/{k}", f"<body><div id=content><div class=box><p>Start, news, about us</p></div><div class=story><p>Story {k}</p></div><div class=south-side><p>South of {k}</p></div></div><div class=dateline>Day {k}</div><div class=slogan>All the best</div><div class=post-comments>Hello {k}</div></body>")
        for k in range(12)
    ]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3\nSouth of 3\nDay 3"


def test_importance_equals_a_plain_count(spark):
    pages = [(f"http://{'ab'[k % 2]}.example/{k}", f"<body><nav>Menu{'' if k % 3 else ' more'}</nav><div class=x><p>Text {k}</p>{'<p>And so on</p>' * (k % 4)}</div><div>Same</div></body>") for k in range(30)]
    pages += [pages[0], ("http://a.example/lone", "<main><h2>Only here</h2></main>"), (None, None)]
    got = {r.path: r.importance for r in h.importance(h.nodes(spark.createDataFrame(pages, "url string, html string"))).collect()}
    having, texts, shapes, above = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set)), {}
    for url, page in set(pages):
        host = h.host_of(url)
        blocks, elements = h.parse(page or "")
        for e in elements:
            having[host, e.path].add(page)
            shapes[host, e.path][tuple(e.children)].add(page)
        for b in blocks:
            texts[host, b.path][b.text].add(page)
            above[host, b.path] = (host, b.parent)

    def presentation(key):
        m, counts = len(having[key]), [len(v) for v in shapes[key].values()]
        total = sum(counts)
        return 1.0 if m <= 1 else min(1.0, -sum(n / total * math.log(n / total) for n in counts) / math.log(m))

    want = {}
    for key, found in texts.items():
        m = len(having[key])
        if m > 1:
            content = 1 - sum(math.log(len(v)) for v in found.values()) / len(found) / math.log(m)
            want[h._hash(*key)] = h.DECAY * content + (1 - h.DECAY) * presentation(above[key])
    assert got.keys() == want.keys() and len(want) == 6
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="page has-sidebar"><article><p>Hello world</p></article></div>', "Hello world"),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>Text</p></article>', "Title\nText"),
        ('<article><p>One</p><section class="legal"><p>Of law</p></section><section id="reviews"><p>Reviewed</p></section></article>', "One\nOf law\nReviewed"),
        ("<article><p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here</p></article>", "Energy E=m here"),
        ("<article><p>Before <svg><text>x</text></svg><script>1 < 2</script>after</p></article>", "Before after"),
        ('<article><p>One</p><div class="ad-slot">Buy</div><div class="share">Share</div><div class="sidebar">Side</div></article>', "One"),
        ('<div class="legal"><p>All rights</p></div><article><p>One</p></article>', "One"),
    ],
)
def test_names_around_and_in_an_article(page, text):
    assert "\n".join(h.kept_blocks(f"<html><body>{page}</body></html>", "h", set())) == text


def test_text_equals_plain_rules_over_plain_counts(spark):
    rows = [(k, f"http://{'ab'[k % 2]}.example/{k}", f"<body><div class=top>Start here</div><div class=box>{'Same words' if k % 3 else f'Own {k}'}</div><main><p>Story {k}</p><p>{'Shared end' if k % 4 else f'End {k}'}</p></main><div class=south-side>South {k}</div><nav>Go {k}</nav></body>") for k in range(24)]
    having, texts, shapes = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    for k, url, page in rows:
        blocks, elements = h.parse(page)
        for e in elements:
            having[url[:8], e.path].add(k)
            shapes[url[:8], e.path][tuple(e.children)].add(k)
        for b in blocks:
            texts[url[:8], b.path][b.text].add(k)
    removed = 0

    def kept(url, b):
        nonlocal removed
        key, up = (url[:8], b.path), (url[:8], b.parent)
        m = len(having[key])
        counts = [len(v) for v in shapes[up].values()]
        presentation = min(1.0, -sum(n / sum(counts) * math.log(n / sum(counts)) for n in counts) / math.log(len(having[up])))
        importance = h.DECAY * (1 - sum(math.log(len(v)) for v in texts[key].values()) / len(texts[key]) / math.log(m)) + (1 - h.DECAY) * presentation
        weight = h.NOISE if b.noise else (h.ARTICLE if b.main else h.OUTSIDE) * (h.SOFT if b.soft else 1.0)
        removed += weight >= h.THRESHOLD > weight * importance
        return weight * importance >= h.THRESHOLD

    want = {k: "\n".join(b.text for b in h.parse(page)[0] if kept(url, b)) for k, url, page in rows}
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and removed > 20 and all(f"Story {k}" in v and "Start" not in v and "Go" not in v for k, v in want.items())
