"""Main text of pages as common systems write them, put down by hand and not used for training; + marks a line that belongs to the text."""

import pytest

from textquarry.llm import html_extract

LONG = "This is a long paragraph about many things, in which a reader can find what happened and when and why it did."
NAV = "<nav><ul><li><a href=/x>Menu</a></li></ul></nav>"

PAGES = {
    "blog with a theme's body classes": """<!DOCTYPE html><html lang="en"><head><title>The tide tables - Harbour notes</title><meta charset="utf-8"></head>
<body class="post-template-default single single-post postid-81 single-format-standard has-sidebar no-header-image wp-embed-responsive comments-open">
<a class="skip-link screen-reader-text" href="#content">Skip to content</a>
<header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">Harbour notes</a></p><p class="site-description">Small boats, big weather</p></div>
<nav id="site-navigation" class="main-navigation"><button class="menu-toggle">Menu</button><ul id="primary-menu" class="menu"><li class="menu-item"><a href="/">Home</a></li><li class="menu-item"><a href="/about">About</a></li></ul></nav></header>
<div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main">
<article id="post-81" class="post-81 post type-post status-publish format-standard has-post-thumbnail hentry category-tides">
<header class="entry-header"><h1 class="entry-title">+The tide tables</h1></header>
<div class="entry-content"><p>+Every spring the harbour master pins a new set of tide tables to the board beside the slip.</p>
<p>+They are printed on card, because paper does not last a week out there.</p>
<h2 class="wp-block-heading">+How to read them</h2><p>+Find the day, then the hour, and add one if the clocks have changed.</p>
<ul class="wp-block-list"><li>+High water is in bold.</li><li>+Springs are marked with a dot.</li></ul>
<blockquote class="wp-block-quote"><p>+If in doubt, wait.</p></blockquote></div></article>
<nav class="navigation post-navigation"><div class="nav-links"><a href="/p">Previous: The slipway</a> <a href="/n">Next: Fog</a></div></nav>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><p>Lovely piece, we used these cards for years.</p></article></li>
<li class="comment"><article class="comment-body"><p>Where can I buy one of these cards, please?</p></article></li></ol>
<div id="respond" class="comment-respond"><h3>Leave a Reply</h3><form><p><label>Comment</label><textarea></textarea></p></form></div></div></main></div>
<aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2 class="widget-title">Recent Posts</h2><ul><li><a href="/1">Fog</a></li><li><a href="/2">The slipway</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by software</div></footer></body></html>""",
    "newsletter post": """<html><body class="typography pencraft layout-wide modal-open"><div id="entry"><div id="main" class="main typography use-theme-bg"><div class="pencraft topbar"><a href="/">Letters from the mill</a><button>Subscribe</button><button>Sign in</button></div>
<div class="single-post-container"><div class="container"><div class="single-post"><article class="newsletter-post post"><div class="post-header"><h1 class="post-title published">+What the mill race carries</h1><h3 class="subtitle">+Notes after a wet November</h3></div>
<div class="available-content"><div class="body markup"><p>+The race was brown for eleven days, and on the twelfth it cleared so fast that you could count the stones.</p><p>+I counted forty.</p>
<div class="captioned-image-container"><figure><img src="a.jpg"><figcaption class="image-caption">+The race, looking north</figcaption></figure></div><p>+More next week, when the sluice has been mended.</p></div></div>
<div class="subscription-widget-wrap"><div class="subscription-widget"><p>Thanks for reading! Subscribe for free to receive new posts.</p><form><input type="email"><button>Subscribe</button></form></div></div></article></div></div></div></div></div>
<div class="footer-wrap"><div class="footer"><p>Start writing today</p></div></div></body></html>""",
    "news site": """<html class="no-js right-sidebar"><body class="article-page layout-sidebar-right header-fixed"><div id="cookie-consent" class="cookie-banner"><p>We and our partners store cookies on your device. You can change your choice at any time.</p><button>Accept all</button></div>
<div class="ad-slot ad-leaderboard"><p>Advertisement</p></div><header class="page-header"><a href="/">The Valley Post</a><nav class="nav-primary"><a href="/news">News</a><a href="/sport">Sport</a><a href="/weather">Weather</a></nav></header>
<div class="page-wrapper with-sidebar"><div class="row"><div class="col-8 article-column"><div class="article__header"><h1 class="article__title">+Bridge to reopen after two years</h1></div>
<div class="article__body"><p class="article__lead">+The stone bridge at Upper Ford will reopen to cars on Monday, the county said.</p><p>+Work began after a flood undercut the eastern pier.</p>
<div class="ad-slot ad-inline"><span>Advertisement</span></div><p>+Engineers found that the pier stood on oak piles, most of them sound.</p>
<aside class="related-articles"><h3>Read more</h3><ul><li><a href="/f">Flood damage put at two million</a></li></ul></aside><p>+A weight limit of seven tonnes stays in place.</p>
<table class="data-table"><tr><th>+Year</th><th>+Cars a day</th></tr><tr><td>+2019</td><td>+3,100</td></tr></table></div>
<div class="share-bar"><a href="/fb">Share</a><a href="/tw">Post</a></div><section class="reader-comments"><h2>Comments</h2><div class="comment"><p>About time too, my commute has doubled since that flood.</p></div></section></div>
<div class="col-4 sidebar"><div class="most-read"><h3>Most read</h3><ol><li><a href="/1">Council tax to rise</a></li><li><a href="/2">Dog found after nine days</a></li></ol></div></div></div></div>
<footer class="site-footer"><p>Copyright The Valley Post. All rights reserved.</p></footer></body></html>""",
    "encyclopedia": """<html class="client-nojs vector-feature-toc-pinned-enabled"><body class="skin-vector mediawiki ltr sitedir-ltr ns-0 ns-subject page-Heron rootpage-Heron action-view"><div id="mw-head"><div id="p-personal"><ul><li><a href="/l">Log in</a></li></ul></div></div>
<div id="mw-panel" class="mw-sidebar"><nav><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random article</a></li></ul></nav></div>
<main id="content" class="mw-body"><h1 id="firstHeading" class="firstHeading mw-first-heading">+Heron</h1><div id="bodyContent" class="vector-body"><div id="mw-content-text" class="mw-body-content"><div class="mw-parser-output"><p>+<b>Herons</b> are long-legged birds that feed in shallow water.</p>
<h2>+Description</h2><p>+They stand up to a metre tall, and fly with the neck drawn back.</p><dl><dt>+Bill</dt><dd>+Long and sharp.</dd></dl></div></div></div></main>
<footer id="footer" class="mw-footer"><ul><li>This page was last edited on 3 March.</li><li>Text is available under a licence.</li></ul></footer></body></html>""",
    "documentation": """<html><body><nav class="navbar"><a href="/">tool</a> <a href="/docs">Docs</a></nav><div class="container with-sidebar"><div class="sidebar-container"><ul class="menu__list"><li><a href="/i">Install</a></li><li><a href="/c">Configure</a></li></ul></div>
<main class="docMainContainer"><div class="row"><div class="col"><nav class="theme-doc-breadcrumbs breadcrumbs"><ul><li><a href="/">Home</a></li></ul></nav><article><div class="theme-doc-markdown markdown"><header><h1>+Configure</h1></header><p>+The tool reads one file, and stops at the first error in it.</p>
<pre><code>+port = 80</code></pre><p>+Changes take effect at once.</p><div class="admonition admonition-tip"><p>+Keep a copy of the file.</p></div></div></article><nav class="pagination-nav"><a href="/i">Previous: Install</a></nav></div></div></main></div>
<footer class="footer"><div>Built with care</div></footer></body></html>""",
    "old table layout": """<html><body bgcolor="#ffffff"><table width="100%"><tr><td colspan="2" class="header"><a href="/">Model railways of the north</a></td></tr><tr><td class="menu" width="120"><a href="/a">Engines</a><br><a href="/b">Track</a><br><a href="/c">Links</a></td>
<td class="content"><h1>+Laying curved track</h1><p>+Start from the middle of the curve and work outwards, pinning every third sleeper.<p>+Do not force the rail.<p>+A card template under the track keeps the radius true.</td></tr><tr><td colspan="2" class="footer">Last changed in 2003</td></tr></table></body></html>""",
    "recipe with notes": """<html><body class="recipe-template has-banner"><div class="overlay gdpr-overlay"><p>This site uses cookies to measure visits. Read our policy.</p></div><div class="site"><div class="top-bar"><ul class="social-links"><li><a href="/i">Insta</a></li></ul></div>
<div class="wrap no-sidebar"><main><section class="recipe"><h1>+Barley soup</h1><p class="intro">+A soup for the first cold evening.</p><h3>+You need</h3><ul><li>+200 g barley</li><li>+2 leeks</li></ul><ol><li>+Wash the barley.</li><li>+Simmer for an hour.</li></ol><p>+It keeps for three days.</p></section></main></div>
<div id="newsletter-signup"><h4>Get a recipe a week</h4><form><input><button>Join</button></form></div><div class="user-reviews"><p>Made this twice, we love it, though I add more salt.</p></div><footer>Kitchen diary 2024</footer></div></body></html>""",
    "story with teasers": """<html><body class="menu-open"><div class="page"><div class="page__header"><span>Quarterly</span></div><div class="story story--long"><h1 class="header">+The last ferry</h1><h2 class="side">+A crossing in winter</h2><p class="header">+By our correspondent on the islands</p>
<p>+There were six of us on the last ferry, and a dog that belonged to nobody.</p><p>+The captain sang.</p><figure class="side"><img><figcaption>+The quay at dusk</figcaption></figure><p>+By the time we saw the light at the point, it had begun to snow.</p></div>
<div class="teasers related-stories"><div class="teaser"><h3>Also in this issue</h3><p><a href="/q">The first ferry</a></p></div></div><div class="outbrain"><a href="/o">Ten ferries you must see</a></div><div class="page__footer"><p>Imprint</p></div></div></body></html>""",
}


def blocks(page, marks):
    """The marked lines of a page, in order, by the plain rule of the mark."""
    import html
    import re

    text = re.sub(r"</?(?:b|i|a|span|code|em)\b[^>]*>", "", page)
    found = [html.unescape(x).strip() for x in re.findall(r">([^<]*)", text)]
    return [x[1:] for x in found if x[:1] == "+"] if marks else [x for x in found if x]


def scored(page):
    want = set(blocks(page, True))
    got = html_extract.extract(page.replace(">+", ">")).split("\n")
    hit = sum(len(x) for x in got if x in want)
    return hit, sum(map(len, got)), sum(map(len, want)), [x for x in got if x not in want], sorted(want - set(got))


def test_precision_and_recall_on_pages_by_hand():
    hit = found = wanted = 0
    for name, page in PAGES.items():
        h, f, w, extra, lost = scored(page)
        print(name, "extra:", extra, "lost:", lost)
        hit, found, wanted = hit + h, found + f, wanted + w
        assert h > 0.5 * w, name
    print("precision", hit / found, "recall", hit / wanted)
    assert hit / found >= 0.9 and hit / wanted >= 0.9


@pytest.mark.parametrize("name", "has-sidebar no-sidebar right-sidebar with-header header-fixed has-banner modal-open menu-open comments-open layout-side format-standard".split())
@pytest.mark.parametrize("where", ["html", "body", "main", "div", "article"])
def test_names_of_the_layout_empty_no_page(name, where):
    c = {x: f' class="{name}"' if x == where else "" for x in ("html", "body", "main", "div", "article")}
    page = f"<html{c['html']}><body{c['body']}>{NAV}<main{c['main']}><div{c['div']}><article{c['article']}><h1>Head</h1><p>{LONG}</p></article></div></main><footer>end</footer></body></html>"
    assert html_extract.extract(page) == f"Head\n{LONG}"


@pytest.mark.parametrize("part", ['<h1 class="header">Head</h1>', '<h2 class="side">Head</h2>', '<p class="header">Head</p>', '<figure class="side"><figcaption>Head</figcaption></figure>', '<blockquote class="header">Head</blockquote>'])
def test_names_of_place_on_parts_of_a_text(part):
    assert html_extract.extract(f"<body>{NAV}<article>{part}<p>{LONG}</p></article></body>") == f"Head\n{LONG}"


@pytest.mark.parametrize("control", ["<button>Go</button>", "<select><option>A</option></select>", "<textarea>abc</textarea>", "<dialog><p>Hi</p></dialog>"])
def test_controls_are_no_text(control):
    assert html_extract.extract(f"<body><article><p>{LONG}</p>{control}<p>{LONG} 2</p></article></body>") == f"{LONG}\n{LONG} 2"


OTHERS = "responses reader-opinions user-reviews feedback conversation talkback adsbygoogle taboola outbrain gdpr paywall overlay".split()


@pytest.mark.parametrize("name", OTHERS)
@pytest.mark.parametrize("tag", ["div", "section", "aside"])
def test_comments_adverts_and_layers_are_left_out(name, tag):
    other = f'<{tag} class="{name}"><h3>Title</h3><p>{LONG} x</p><p>{LONG} y</p></{tag}>'
    assert html_extract.extract(f"<body>{NAV}<article><h1>Head</h1><p>{LONG}</p></article>{other}</body>") == f"Head\n{LONG}"
    assert html_extract.extract(f"<body>{NAV}<article><h1>Head</h1><p>{LONG}</p>{other}<p>{LONG} 2</p></article></body>") == f"Head\n{LONG}\n{LONG} 2"


def test_quotes_that_never_close():
    assert html_extract.extract('<p title="abc>Hello</p>') == ""
    assert html_extract.extract('<p title="abc>Hello</p><p class="x">Bye</p><p>So</p>') == "Bye\nSo"
    assert html_extract.extract("<p title=it's>Hello</p><p data-x='a>b'>Yes</p>") == "Hello\nYes"
