import re
from html import unescape

import pytest

from rigspark.llm.html import default_field, extract_text, labelled_pages, leaf_blocks, main_text, page_texts

#: Hand-written pages and the main text that a reader would take from each.
PAGES = [
    ("""<article><p title=it's>Hello world text one.</p><p data-y=don't>More article text here.</p></article>""",
     ["Hello world text one.", "More article text here."]),
    ("""<!doctype html><html><head><title>River levels - The Daily Post</title><script type="text/javascript">if (a > b) { document.write("<p>no</p>"); }</script></head>
<body class="single-post"><div id="topbar"><a href="/login">Log in</a> | <a href="/register">Register</a></div>
<div class="site-header"><a class="logo" href="/">The Daily Post</a></div>
<ul class="menu"><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/weather">Weather</a></li></ul>
<div class="post-content"><h1>River levels rise after a week of rain</h1>
<p>The river rose by two metres on Monday, the highest level in ten years, and flooded several cellars in the old town.</p>
<div class="advertisement">Best boots for wet days, now 30% off!</div>
<p>&ldquo;We had to carry the sandbags ourselves,&rdquo; said a shop owner &ndash; &quot;nobody came&quot;.</p>
<blockquote>It was not the first flood, and it will not be the last one.</blockquote></div>
<div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Bridge closed</a></li><li><a href="/2">School opens</a></li></ul></div>
<div id="comments"><h3>2 comments</h3><div class="comment"><p>My cellar was full of water too, and no one helped me for three days.</p></div></div>
<div id="footer">&copy; 2019 The Daily Post. All rights reserved. <a href="/imprint">Imprint</a></div></body></html>""",
     ["River levels rise after a week of rain", "The river rose by two metres on Monday, the highest level in ten years, and flooded several cellars in the old town.", "“We had to carry the sandbags ourselves,” said a shop owner – \"nobody came\".", "It was not the first flood, and it will not be the last one."]),
    ("""<html><body><header><h2>Cooking Corner</h2><nav><a href=/>Home</a> <a href=/r>Recipes</a> <a href=/a>About</a></nav></header>
<main><h1>Lentil soup</h1><p>A simple soup for cold evenings, ready in half an hour.
<h2>Ingredients</h2><ul><li>200 g of red lentils<li>one onion<li>salt &amp; pepper</ul>
<h2>Method</h2><ol><li>Chop the onion and fry it in a little oil until it is soft.<li>Add the lentils and a litre of water, then let everything simmer for twenty minutes.</ol>
<div class="share-buttons"><a href="#">Share</a><a href="#">Print</a></div></main>
<aside><h4>About the author</h4><p>Jo has been writing about food since 2004 and lives by the sea with two cats.</p></aside>
<footer><p>Cooking Corner, made with love.</p></footer></body></html>""",
     ["Lentil soup", "A simple soup for cold evenings, ready in half an hour.", "Ingredients", "200 g of red lentils", "one onion", "salt & pepper", "Method", "Chop the onion and fry it in a little oil until it is soft.", "Add the lentils and a litre of water, then let everything simmer for twenty minutes."]),
    ("""<body><div class='cookie-banner' role="dialog"><p>This site uses cookies to give you the best experience. By using it you agree.</p><button>Accept</button></div>
<article class=entry><h2>Release 2.1</h2><p>This release fixes the crash when a file name holds a quote, such as <code>it's.txt</code>.</p>
<pre>run --all
run --fast</pre><table><tr><th>Version</th><th>Date</th></tr><tr><td>2.1</td><td>May 2</td></tr></table></article>
<form action="/subscribe"><label>E-mail</label><input name=e><button>Subscribe to our newsletter</button></form></body>""",
     ["Release 2.1", "This release fixes the crash when a file name holds a quote, such as it's.txt.", "run --all run --fast", "Version", "Date", "2.1", "May 2"]),
    ("""<html><head><style>.a{color:red}</style></head><body><nav aria-label=main><ul><li><a href=/a>Alpha</a><li><a href=/b>Beta</a></ul></nav>
<article><h1>Short note</h1><p>Done.</p><p>Really.</p></article><!-- <p>hidden</p> --><footer>Contact us by mail or phone.</footer></body></html>""",
     ["Short note", "Done.", "Really."]),
    ("""<html><body><nav><a href="/">Start</a></nav><div class="notice">Our office is closed on Friday.</div><footer>Imprint</footer></body></html>""", []),
    ("""<html><body><div class="header"><h1>My site</h1></div><div class="content"><div>Unlike most pages, this one keeps its paragraphs in plain boxes, without any paragraph element at all.</div><div>A second box follows the first one, and it is a little shorter.</div></div><div class="footer">Copyright 2021 My site</div></body></html>""",
     ["Unlike most pages, this one keeps its paragraphs in plain boxes, without any paragraph element at all.", "A second box follows the first one, and it is a little shorter."]),
    ("""<article><header class="page-header"><p>Skip to content</p></header><h1 id=x>Über Züge</h1><p>Die Züge fahren seit gestern wieder p&uuml;nktlich&nbsp;&ndash; jedenfalls fast&hellip;</p><aside class="related"><a href="/x">Mehr dazu</a></aside><p>Morgen &#x2014; so hei&#223;t es &mdash; soll auch der Nachtzug wieder fahren.</p></article>""",
     ["Über Züge", "Die Züge fahren seit gestern wieder pünktlich – jedenfalls fast…", "Morgen — so heißt es — soll auch der Nachtzug wieder fahren."]),
    ("""<body><article><h1>Licence of the tool</h1><p>Copyright (c) 2020 the makers. Permission is granted to use this tool for any purpose.</p><p>All rights reserved by the makers for the name of the tool.</p></article><div class="copyright">&copy; 2020 Example</div></body>""",
     ["Licence of the tool", "Copyright (c) 2020 the makers. Permission is granted to use this tool for any purpose.", "All rights reserved by the makers for the name of the tool."]),
    ("""<div id=main><h1>Why we walk</h1><p>Walking is the oldest way to travel, and <a href="/why">many say</a> it is still the best one for short distances.<p>It costs nothing<br>and needs no ticket.<div class="ad-slot"><span>Buy new shoes today and save a lot of money on your second pair.</span></div><p>So take a walk this evening.</div><section class="comments"><article><p>Great text, I walk every day with my dog and enjoy it.</p></article></section>""",
     ["Why we walk", "Walking is the oldest way to travel, and many say it is still the best one for short distances.", "It costs nothing and needs no ticket.", "So take a walk this evening."]),
]


def test_blocks_of_careless_markup():
    page = """<!DOCTYPE html><!-- <p>no</p> --><title>T</title><script>var a="</p><p>x";</script><STYLE>p{}</STYLE>
    <div class='postBody x-1' id=main><p>One &amp; two &copy<br>three <b>bold<p>Next <a href="a>b">li<i>n</i>k</a> 1 < 2</div>end&nbsp;here<ul><li>a<li>b</ul><p title='unclosed>tail"""
    got = leaf_blocks(page)
    assert [b.text for b in got][:4] == ["T", "One & two © three bold", "Next link 1 < 2", "end here"]
    assert [b.text for b in got][4:6] == ["a", "b"]
    assert {".post", ".body", ".main", "<div>", "<p>"} <= got[1].above and "<div>" not in got[3].above and "<b>" not in got[2].above
    assert got[2].links == len("link")
    assert leaf_blocks("") == [] and leaf_blocks(" \n<p></p>") == []


def test_held_out_labelled_pages():
    field, right, n = default_field(), 0, 0
    for blocks, labels in labelled_pages(150, seed=77):
        got = field.decode(blocks, {})
        right, n = right + sum(a == b for a, b in zip(got, labels, strict=True)), n + len(labels)
    assert right >= 0.97 * n


def test_viterbi_matches_enumeration():
    import itertools

    field = default_field()
    for blocks, _ in labelled_pages(40, seed=5):
        blocks = blocks[:7]
        e = [field.emission(b, i / max(len(blocks) - 1, 1), {}) for i, b in enumerate(blocks)]
        score = lambda ys: sum(x * y for x, y in zip(e, ys)) + sum(field.change[a, b] for a, b in zip(ys, ys[1:]))
        best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
        assert abs(score(best) - score([int(y) for y in field.decode(blocks, {})])) < 1e-9


def test_article_without_the_rest():
    page = """<html><head><title>Title</title></head><body><header class="site-header"><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies to improve your experience.</p></div>
    <article><h1>The headline</h1><p>First  paragraph of &quot;text&quot;, with some words in it.</p><div class="ad">Buy this now, it is cheap.</div><p>Yes.</p><p>Second paragraph of text, which is longer than the first one was.</p></article>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=/a>Another story</a></li></ul></aside>
    <section id="comments"><p>I liked this article very much, thank you.</p></section>
    <form><label>Name</label><input name=n><button>Send</button></form><footer>&copy; 2020 The Site</footer></body></html>"""
    assert main_text(page, default_field(), {}) == 'The headline\n\nFirst paragraph of "text", with some words in it.\n\nYes.\n\nSecond paragraph of text, which is longer than the first one was.'


def test_hand_written_pages():
    for page, want in PAGES:
        assert main_text(page, default_field(), {}) == "\n\n".join(want)


def test_quotes_count_only_where_a_value_begins():
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    assert texts("<p title=it's>One.</p><p data-y=don't>Two.</p>") == ["One.", "Two."]
    assert texts("<p a='x>y' b=\"p>q\" c = 'r>'>One.</p><p \"d'>Two.</p><p e=>Three.</p>") == ["One.", "Two.", "Three."]
    assert texts("<p a=\"never ends>One. <b>Two</b></p>") == ["One. Two"]
    assert texts("<script-x>One</script-x><script src='>'>no</script\n x>Two") == ["One Two"] or texts("<script-x>One</script-x><script src='>'>no</script\n x>Two") == ["OneTwo"]
    assert texts("<p>1 < 2 and 3 > 2</p><p>a</>b</ c>d</p>") == ["1 < 2 and 3 > 2", "abd"]
    assert texts("<p " + "a='b' " * 20_000 + ">One.</p>" + "<p x='" * 2000 + ">Two.")[0] == "One."


def test_given_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = page_texts(pages).collect()
    assert len(got) == len(html)
    right = 0
    for r in got:
        # These pages hold one article of headings and paragraphs without nested blocks.
        article = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        right += r.text == "\n\n".join(x for x in blocks if x)
        assert r.n_chars == len(r.text)
    assert right == len(got)


def test_edges(spark):
    rows = [(1, "u", None, "old", 1), (2, "u", "", "old", 1), (2, "u", "", "old", 1), (None, None, "<nav><a href=/>x</a></nav>", "old", 1), (3, "u", "<article><p>" + "Long words here. " * 50_000, "old", 1), (4, "u", "<div>" * 3000 + "<p>Deep text of a page, in many boxes.</p>", "old", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r.text for r in page_texts(pages).collect()}
    assert got[1] == "" and got[2] == "" and got[None] == "" and len(got[3]) == 17 * 50_000 - 1
    assert extract_text(pages).columns == ["page_id", "url", "n_chars", "text"]
    assert page_texts(pages.limit(0)).count() == 0


ARTICLE = "<h1>A fine title here</h1><p>The first paragraph says something of interest, at some length.</p><p>The second one goes on and ends.</p>"
ARTICLE_TEXT = "A fine title here\n\nThe first paragraph says something of interest, at some length.\n\nThe second one goes on and ends."
AROUND = "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></nav>{}<footer><p>&copy; Example. All rights reserved.</p></footer>"


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("name", ["", "post", "main-content", "post with-sidebar", "post has-sidebar", "post category-news tag-links", "post comments-open", "content-with-ads", "entry post-notice", "hentry type-post status-publish format-standard category-sidebar", "page no-sidebar has-comments"])
def test_names_of_the_main_element_drop_nothing(tag, name):
    page = AROUND.format(f"<{tag} class='{name}'>{ARTICLE}</{tag}>")
    assert main_text(page, default_field(), {}) == ARTICLE_TEXT


def test_pages_without_names_or_tags():
    text = "Just plain text without any tags. It has two sentences."
    assert main_text(text, default_field(), {}) == text
    assert main_text("<p>One paragraph only.</p>", default_field(), {}) == "One paragraph only."
    wrapped = AROUND.format(f"<div class='wrap with-sidebar'><div class='post'>{ARTICLE}</div><div class='sidebar'><p>About me and more.</p></div></div>")
    assert main_text(wrapped, default_field(), {}) == ARTICLE_TEXT
    assert main_text(AROUND.format(f"<div>{ARTICLE}</div><div class='x7'>Imprint</div>"), default_field(), {}) == ARTICLE_TEXT


#: Pages of other makes than the generator's; ``+`` marks the blocks that are main text.
WRITTEN = [
    """<body class="home blog sidebar-right"><div id="page" class="hfeed site"><div class="skip-link"><a href="#c">Skip to content</a></div><header id="masthead"><p class="site-title"><a href="/">Garden Notes</a></p><nav class="main-navigation"><ul class="menu"><li><a href="/">Start</a><li><a href="/about">About</a></ul></nav></header>
    <div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-12" class="post-12 post type-post hentry category-garden tag-soil comments-open"><h1 class="entry-title">+Digging in spring</h1><div class="entry-content"><p>+Wait until the soil crumbles in your hand.</p><p>+Then turn it over, a spade deep, and leave it to the birds.</p><blockquote><p>+Patience is half the harvest.</p></blockquote></div></article>
    <div id="comments" class="comments-area"><h2>2 thoughts on this</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><p>Works for me as well, thank you!</p></article></ol><form class="comment-form"><label>Your reply</label><textarea></textarea></form></div></main></div>
    <aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/1">Compost</a></ul></section></aside><footer class="site-footer"><p>Proudly powered by nothing.</p></footer></div></body>""",
    """<html><body><center><table width=700><tr><td bgcolor=silver><a href=i.html>Index</a> | <a href=n.html>Next</a></td></tr><tr><td><h2>+The old lighthouse</h2><p>+It was built in 1821 of grey stone, and the sea has taken two of its three keepers' houses since.<p>+Visitors climb 112 steps. The lamp was put out for good in 1974.</td></tr></table></center></body></html>""",
    """<div class="cookie-banner"><p>We use cookies to improve your visit. <button>Accept</button></p></div><header class="top-bar"><a class="logo" href="/">Daily Herald</a></header><main><section class="story" itemprop="articleBody"><h1>+Bridge to open a year late</h1><p>+The new bridge will not open before next autumn, the council said on Monday.</p><div class="ad-slot">Sponsored: the best mattress of the year.</div><p>+Costs have risen by a third, and two of the four builders have left.</p><ul class="share-buttons"><li><a href="#">Share</a></li></ul></section><section class="related"><h3>Read more</h3><ul><li><a href="/x">Ferry fares rise again</a></li></ul></section></main><footer>Copyright 2021 Daily Herald. All rights reserved.</footer>""",
    """<div class="layout has-toc"><div class="toc"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ul></div><div class="markdown-body content"><h1>+Install</h1><p>+Unpack the archive into any folder.</p><pre>+tar xf tool.tar</pre><h2>+Use</h2><p>+Run the tool on a file to see its parts.</p><ol><li>+Open a shell.</li><li>+Type the name of the tool.</li></ol></div><div class="pagination"><a href="/p">Previous</a> <a href="/n">Next</a></div></div>""",
]


def test_hand_written_pages_of_other_makes():
    hit = kept = true = 0
    for page in WRITTEN:
        got = main_text(page.replace("+", ""), default_field(), {}).split("\n\n")
        want = [b.text[1:] for b in leaf_blocks(page) if b.text.startswith("+")]
        hit, kept, true = hit + len(set(got) & set(want)), kept + len(got), true + len(want)
    print(f"block precision {hit / kept:.3f}, recall {hit / true:.3f}")
    assert hit / true >= 0.95 and hit / kept >= 0.85
