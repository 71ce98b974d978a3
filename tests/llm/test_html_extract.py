import random

from mosaiq.llm import html_extract as H

MODEL = H.train(150)


def text_of(page):
    return H.extract_all(MODEL, [page])[0]


def test_held_out_generated_pages():
    rnd, wrong, total = random.Random(123), 0, 0
    for _ in range(150):
        page, main = H._generated(rnd)
        wrong += len(set(text_of(page)) ^ main)
        total += len(main)
    assert wrong < 0.05 * total


def test_page_with_all_kinds_of_boilerplate():
    page = (
        '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>'
        '<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">two</a></li></ul></nav><!-- x --><div class="ad">Buy this now.</div>'
        "<article><h1>Head&amp;line</h1><p><b>First   words here, and\n more of them.<br><p>Second &lt;b&gt; paragraph, with a little more text in it.</p></article>"
        "<footer>&copy; host &middot; Imprint</footer></body></html>"
    )
    assert text_of(page) == ["Head&line", "First words here, and more of them.", "Second <b> paragraph, with a little more text in it."]


def test_decoding_keeps_nothing_below_a_dropped_node():
    nodes, _ = H.features(H.parse("<nav><p>one</p></nav><article><p>two</p></article>"), 50)
    odds = [{"nav": -9.0, "html": 9.0}.get(n.tag, 3.0) for n in nodes]
    assert H.decode(nodes, H.np.array(odds)) == ["two"]


def test_odd_markup_and_empty_pages(spark):
    odd = [None, "", "plain", "<p", "<a href=\"x", "<p>a<p>b</div></div>", "<script>never", "a < b <3", "<br/>" * 50, "<div>" * 2000 + "deep"]
    pages = spark.createDataFrame([(i, "u", h, 7) for i, h in enumerate(odd)], "page_id long, url string, html string, text int")
    rows = {r.page_id: r for r in H.extract_pages(pages, model=MODEL).collect()}
    assert len(rows) == len(odd) and rows[0].text == rows[1].text == "" and all(r.n_chars == len(r.text) for r in rows.values())
    assert H.extract_pages(pages.limit(0), model=MODEL).collect() == []


def test_share_of_siblings_with_the_same_tag_in_long_articles():
    page = "<article>" + "<p>x</p>" * 299 + "<aside>y</aside></article>"
    nodes, x = H.features(H.parse(page), len(page))
    share = {n.tag: row[len(H.TAG_GROUPS) + 3] for n, row in zip(nodes, x, strict=True)}
    assert abs(share["aside"] - 1 / 300) < 1e-6 and abs(share["p"] - 299 / 300) < 1e-6


def test_text_around_blocks_stays_in_page_order():
    page = "<article><ul><li>alpha one, two.<p>beta inner text here.</p>gamma after, the end.</li></ul><table><tr><td>left<div>mid of it, here.</div>right<script>x()</script> side</td></tr></table></article>"
    root = H.parse(page)
    kept = H.decode(H.features(root, len(page))[0], H.np.full(len(H._walk(root)), 9.0))
    assert kept == ["alpha one, two.", "beta inner text here.", "gamma after, the end.", "left", "mid of it, here.", "right side"]


def test_hand_written_layouts():
    table = """<html><body bgcolor=white><table width=100%><tr><td colspan=2><a href=/>Home</a> | <a href=/n>News</a> | <a href=/c>Contact</a></td></tr>
    <tr><td class=menu><a href=/1>One</a><br><a href=/2>Two</a><br><a href=/3>Three</a></td>
    <td class=content><h1>The old bridge</h1><p>The bridge was built in 1872, and it has carried carts, cars and trains since then.
    <p>Its arches are of local stone; the masons came from three valleys around.</td></tr></table></body></html>"""
    assert text_of(table) == ["The old bridge", "The bridge was built in 1872, and it has carried carts, cars and trains since then.", "Its arches are of local stone; the masons came from three valleys around."]
    divs = """<body><div id="navbar"><a href=a>A</a> <a href=b>B</a> <a href=c>C</a></div><div id="main" class="post-content"><div class="title"><h2>Soup</h2></div>
    <div>Put the leeks into the pot, with water and a little salt.</div><div>Let it simmer for an hour, then serve.</div></div><div id="footer">Legal notice, imprint</div></body>"""
    assert text_of(divs) == ["Soup", "Put the leeks into the pot, with water and a little salt.", "Let it simmer for an hour, then serve."]


#: Pages written by hand: (html, blocks of its article).
WRITTEN = [
    ('<article class="sidebar-layout"><p>The first words of an article, which is short.</p></article>', ["The first words of an article, which is short."]),
    ('<article><p>Some text here, as it was. <span class="ad">BUY NOW</span> More text.</p><p>And a second one, longer than the first.</p></article>', ["Some text here, as it was. More text.", "And a second one, longer than the first."]),
    (
        '<body class="has-sidebar"><div class="sidebar"><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></div><main class="page header-fixed"><h1>Rain</h1><p>It rained for three days, and the river rose.</p>'
        '<p>See the <em class="legal-term">force majeure</em> clause, please.</p><section class="comments"><h3>Comments</h3><div class="comment"><p>First!</p></div></section></main></body>',
        ["Rain", "It rained for three days, and the river rose.", "See the force majeure clause, please."],
    ),
    (
        '<html><body><aside id="sidebar"><h3>Popular</h3><ul><li><a href=/1>Ten tips</a></li><li><a href=/2>Five facts</a></li></ul></aside><article><h1>Tea</h1><p>Tea is grown on hills, where nights are cool.</p><ul><li>Green tea is steamed.</li><li>Black tea is left to wither.</li></ul></article></body></html>',
        ["Tea", "Tea is grown on hills, where nights are cool.", "Green tea is steamed.", "Black tea is left to wither."],
    ),
    (
        '<article><h2>Clocks</h2><p>The tower clock has one hand only.</p><div class="advert"><p>Watches at half price!</p></div><p>It was made in 1593, by a smith of the town.</p><div class="comments"><div class="comment"><p>Lovely.</p></div><div class="comment"><p>I saw it, too.</p></div></div></article>',
        ["Clocks", "The tower clock has one hand only.", "It was made in 1593, by a smith of the town."],
    ),
    (
        '<header><h1>The Daily</h1><nav><a href=/>Home</a> <a href=/w>World</a></nav></header><main><h1>Ships</h1><blockquote>No ship is without a leak, sailors say.</blockquote><p>This one had two.</p></main><form action=/s>Search <input name=q><button>Go</button></form><footer>All rights reserved</footer>',
        ["Ships", "No ship is without a leak, sailors say.", "This one had two."],
    ),
    ('<div class="cookie-notice"><p>We use cookies.</p><button>Accept</button></div><article><p>A &lt;b&gt; tag makes text bold; &amp; is written so.</p></article>', ["A <b> tag makes text bold; & is written so."]),
    ('<article><h1>Über Äpfel</h1><p>Der Apfel fällt <a class="promo" href=/k>Jetzt kaufen</a> nicht weit vom Stamm.</p></article><footer>Impressum</footer>', ["Über Äpfel", "Der Apfel fällt nicht weit vom Stamm."]),
    ('<nav class="menu"><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav><article><p>One <span class="share">Share <b>this</b> page</span><i>word</i> only.</p><p>Then <span lang="la">finis</span>, they wrote.</p></article>', ["One word only.", "Then finis, they wrote."]),
    ('<article><h1>Maps</h1><table><tr><th>Year</th><td>1513</td></tr><tr><th>Place</th><td>Saint-Dié, in the Vosges</td></tr></table><p>The map was lost for long.</p></article><aside><p>Read this as well</p><a href=/x>More</a></aside>', ["Maps", "Year", "1513", "Place", "Saint-Dié, in the Vosges", "The map was lost for long."]),
]


def test_pages_written_by_hand():
    model = H.train()
    assert [H.extract_all(model, [page])[0] for page, _ in WRITTEN] == [blocks for _, blocks in WRITTEN]


def test_inline_nodes_go_or_stay_in_their_place():
    page = '<p>a <span class="ad">b <i>c</i> <span>d</span></span>e<b class="share">f<p>g</p>'
    nodes, x = H.features(H.parse(page), len(page))
    assert [n.tag for n in nodes] == ["html", "p", "#inline", "#inline", "p"] and x.shape[0] == 5
    assert H.decode(nodes, H.np.full(5, 9.0)) == ["a b c def", "g"]
    assert H.decode(nodes, H.np.array([9.0, 9, -9, 9, 9])) == ["a ef", "g"]
    assert H.decode(nodes, H.np.array([9.0, 9, -9, -9, 9])) == ["a e", "g"]
