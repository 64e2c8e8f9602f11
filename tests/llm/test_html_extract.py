"""Main text of pages of known layout, and the scan against all pairs of ends."""

import random

import pytest

from textloom.llm.html_extract import best_region, count_tokens, element_of, extract, html_extract, named, parse, scores_of, train, weigh

ARTICLE = "<h1>Title &amp; more</h1><p>First  words\n of <b>the</b> text, with a <a href=x>link</a> inside it.</p><ul><li>one thing</li><li>two things</li></ul><p>Last line<br>after a break &eacute;&#33;</p>"
WANT = "Title & more\n\nFirst words of the text, with a link inside it.\n\none thing\n\ntwo things\n\nLast line after a break é!"
HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>"
CHROME = "<header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav>"
FOOT = "<aside class='sidebar'><p>Side words that go on for a while.</p></aside><div class='comments'><p>I think so too, said a reader.</p></div><footer>&copy; site</footer></body></html>"


@pytest.mark.parametrize("a,b", [("<article>", "</article>"), ("<main>", "</main>"), ("<main><article class='post'>", "</article></main>"), ("<div id='content'>", "</div>"), ("<div class=\"post-body\">", "</div>")])
def test_layouts(a, b):
    notice = "<div class='cookie-notice'>We use cookies.</div><div class=ad>Buy this now</div><form><label>Mail</label><input name=m></form>"
    divs = "<div class='site-header'><span>Some Site</span></div><div id=header>Words up here</div><div class='content-header'><b>Top of the page</b></div>"
    for page in (HEAD + divs + a + ARTICLE + b + FOOT, HEAD + CHROME + a + ARTICLE + b + FOOT, HEAD + notice + a + ARTICLE + b + FOOT, HEAD + a + ARTICLE + notice + b + FOOT, a + ARTICLE + b):
        assert extract(page, {}) == WANT


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("   \n", ""), ("plain &lt;words&gt; only", "plain <words> only"), ("<nav><a>x</a></nav>", ""), ("<article><p>cut off in <b", "cut off in"), ("<article></article>", ""),
    ("<article><p>a &nbsp; b</p><p> </p><p>c</p></article>", "a b\n\nc"), ("<article><p>x<!-- no --> y</p><script>z</script></article>", "x y"), ("<p>a < b and c > d</p>", "a < b and c > d")])
def test_edges(page, want):
    assert extract(page, {}) == want


def test_long_page_in_linear_time():
    body = "".join(f"<p>word{i} goes here</p>" for i in range(50_000))
    assert extract(f"<nav><a>m</a></nav><article>{body}</article>", {}).count("\n\n") == 49_999
    assert extract("<div>" * 30_000 + "deep", {}) in ("deep", "")


def test_best_region_is_the_best_of_all():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(-5, 6) for _ in range(rng.randrange(0, 15))]
        a, b = best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])


def test_table_with_learned_weights(spark):
    rows = [(i, f"u{i}", HEAD + CHROME + "<article>" + ARTICLE + "</article>" + FOOT) for i in range(20)] + [(50, None, None), (None, "u", "<article><p>x</p></article>"), (3, "u3", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' AS k", "'n' AS inside")
    out = html_extract(df, train(df))
    got = [(r["page_id"], r["text"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted([*((i, WANT) for i in range(20)), (50, ""), (None, "x"), (3, "x")], key=str)
    assert html_extract(df.where("false"), train(df.where("false"))).count() == 0


@pytest.mark.parametrize(("page", "want"), [
    ("<main><article><p>A one two</p></article><p>B three four</p></main>", "A one two\n\nB three four"),
    ("<article><div class='post-content'><p>A one</p></div><p>B two three</p></article>", "A one\n\nB two three"),
    ("<article><p>A one</p><article><p>B two</p></article><p>C three</p><article><p>D four</p></article></article>", "A one\n\nB two\n\nC three\n\nD four"),
    ("<article>" * 3000 + "deep words" + "</article>" * 3000, "deep words")])
def test_no_block_of_the_best_region_is_lost_to_an_inner_home(page, want):
    assert extract(page, {"<article": -0.01, "<p": -0.05, "<div": -0.05}) == want


@pytest.mark.parametrize("names", ["related-work", "search-algorithms", "side-effects", "adaptive", "shareholders", "comment-on-policy", "navigationTheory", "headers-explained", "modal-logic", "", "intro"])
def test_whole_names_decide(names):
    assert named(names)[0] is False
    page = HEAD + CHROME + f"<article><h1>Title</h1><section class='{names}'><p>Some words of this part.</p></section><div id={names or 'x'}><p>More words.</p></div></article>" + FOOT
    assert extract(page, {}) == "Title\n\nSome words of this part.\n\nMore words."


@pytest.mark.parametrize("names", ["sidebar", "left-sidebar", "cookie-notice", "comments-area", "post-comments", "ad", "ad_box", "relatedPosts", "newsletter-signup", "x social-share", "main-nav", "NavBar", "search"])
def test_boilerplate_names(names):
    assert named(names)[0] is True
    page = f"<article><p>Some words.</p><div class='{names}'><p>Words that are none of the article's.</p></div><p>More words.</p></article>"
    assert extract(page, {}) == "Some words.\n\nMore words."


@pytest.mark.parametrize(("page", "want"), [
    ("<article><p>so <math><mi>x</mi><mo>+</mo><mn>1</mn></math> holds</p></article>", "so x+1 holds"),
    ("<article><p>a <svg width=1><title>red</title><text>dot</text></svg> here</p></article>", "a reddot here"),
    ("<article><noscript><p>Kept words</p></noscript><p>and these</p></article>", "Kept words\n\nand these"),
    ("<article><p>pick <select><option>one<option>two</select> of them</p></article>", "pick of them"),
    ("<article><p>press <button>OK</button> now <textarea>x</textarea></p></article>", "press now"),
    ("<article><p>seen <span aria-hidden=true>words</span> <span hidden>unseen</span></p></article>", "seen words"),
    ("<article><p>a<wbr>b <custom-x>c</custom-x></p></article>", "ab\n\nc")])
def test_nothing_else_is_dropped_or_cut(page, want):
    assert extract(page, {}) == want


def learned():
    c = sum((count_tokens(HEAD + CHROME + "<article>" + ARTICLE + "</article>" + FOOT) for _ in range(20)), start=count_tokens(""))
    return weigh(c)


@pytest.mark.parametrize("weights", ["default", "learned"])
def test_pages_without_article(weights):
    w = {} if weights == "default" else learned()
    menu = "<div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a> <a href=4>Four more words</a></div>"
    body = "<p>First words of the text, in a paragraph.</p><p>Second words of the text, in another one.</p><p>End.</p>"
    want = "First words of the text, in a paragraph.\n\nSecond words of the text, in another one.\n\nEnd."
    assert extract(HEAD + menu + f"<div>{body}</div>" + menu + FOOT, w) == want
    assert extract(HEAD + CHROME + f"<table><tr><td>{body}</td></tr></table>" + FOOT, w) == want
    assert extract(HEAD + CHROME + f"<div><div>{body}</div><div class=ad><p>Buy this now and more of it, it is on sale</p></div><div><p>And words after the advert.</p></div></div>" + FOOT, w) == want + "\n\nAnd words after the advert."


def test_learned_weights_decide():
    w = learned()
    assert w["ok|0|p|in"] > 0 > w["bad|0|p|out"] and w["ok|0|p|none"] > 0 > w["bad|1|li|none"]
    flipped = {k: -v if k[0] != "<" else v for k, v in w.items()}
    page = HEAD + CHROME + "<article>" + ARTICLE + "</article>" + FOOT
    assert extract(page, w) == WANT and extract(page, flipped) == ""


def test_growth_takes_the_best_of_all_elements_around():
    rng = random.Random(4)
    tags = ["div", "section", "article", "nav", "p", "b", "ul", "li", "aside"]
    for _ in range(150):
        html, depth = "", []
        for _ in range(rng.randrange(3, 40)):
            x = rng.random()
            if x < 0.35:
                depth.append(rng.choice(tags))
                html += f"<{depth[-1]}>"
            elif x < 0.6 and depth:
                html += f"</{depth.pop()}>"
            else:
                html += " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 6)))
        page = parse(html)
        scores = scores_of(page, {})
        a, b = best_region(scores)
        region = [i for i in range(a, b) if page.tokens[i].text is not None and not page.tokens[i].bad and page.tokens[i].text.strip()]
        if not region:
            assert extract(html, {}) == ""
            continue
        around = [e for e in range(len(page.parent)) if page.begin[e] <= region[0] and region[-1] < page.end[e]]
        score = {e: sum(s for t, s in zip(page.tokens[page.begin[e]: page.end[e]], scores[page.begin[e]: page.end[e]], strict=True) if not t.bad) for e in around}
        got = element_of(page, region[0], region[-1], scores)
        assert got in around and score[got] >= max(score.values()) - 1e-6
