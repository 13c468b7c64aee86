import random

import pytest

from longspan.llm import html_text as h

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="page-7"><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><main><article class="post-%d"><header><h1>Title &amp; more</h1><span>By A</span></header>
<div class="entry"><p>One <a href=x>two</a> three&nbsp;four<br>five.<p>Second   para
 graph</p><ul><li>item a<li>item b</ul><div class="ad">BUY</div><table><tr><td>c1<td>c2</table></div><aside>rel</aside><form>Name <input></form></article>
<section id="comments"><p>A reader's comment, longer than everything else that stands on this page, and longer still, and longer</p></section></main>
<footer>&copy; x</footer><script>if(a<b){"</p><p>code"}</script></body></html>"""
TEXT = "Title & more\nOne two three four five.\nSecond para graph\nitem a\nitem b\nc1\nc2"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS path", "'y' AS text", "1 AS host")


def test_article_only(spark):
    got = h.extract(pages(spark, [(k, f"http://Host.example/{k}", PAGE % k) for k in range(5)])).collect()
    assert {r["text"] for r in got} == {TEXT} and {r["n_chars"] for r in got} == {len(TEXT)}
    assert {r["path"] for r in got} == {"body.page-#>main>article.post-#"}


def test_host_outvotes_a_page(spark):
    """A page whose largest container isn't the article is extracted from its host's path, elsewhere from its own."""
    body = lambda article, other: f'<body><div id="a" class="story"><p>{article}</p></div><div class="box"><p>{other}</p></div></body>'
    usual = body("the article text " * 20, "other")
    odd = body("short article", "a long box of other things " * 30)
    rows = [(k, "http://one.example/x", usual) for k in range(5)] + [(9, "http://one.example/y", odd), (10, "http://two.example/y", odd)]
    got = {r["page_id"]: r["text"] for r in h.extract(pages(spark, rows)).collect()}
    assert got[9] == "short article"
    assert got[10].startswith("a long box")


def test_markup_oddities():
    text = lambda s: h.text_at(h.parse(s), h.best(h.parse(s))[0])
    assert text("<body><article><p>a < b &lt;c&gt; <!-- x --> d<p>e</article>") == "a < b <c> d\ne"
    assert text("<ARTICLE><P CLASS='x>y'>q</P><p hidden>no</p><div style='display: none'>no</div></ARTICLE>") == "q"
    assert text("<article>open <b>bold<p>next</i></article><!-- never closed <p>x") == "open bold\nnext"
    assert text("<article><p>x<script>var a = '</p><p>';</script>y</p></article>") == "xy"
    assert text("plain & text") == "plain & text"


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "http://a.example", "<p>text"), (3, "http://a.example", "<p>text"), (3, "http://a.example", "<p>text"), (4, "http://b.example", "<article>" + "<p>long text</p>" * 20000 + "</article>")]
    got = h.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == "" and by[None] == by[3] == "text" and by[4].count("\n") == 19999
    assert h.extract(pages(spark, [])).collect() == []


def test_layout_wrappers_stay():
    """Classes that tell of a layout leave nothing out, nor does any class of what wraps the content."""
    text = lambda s: h.text_at(h.parse(s), h.best(h.parse(s))[0])
    story = "<p>The story of the page, long enough to be read.</p><p>And more of it.</p>"
    want = "The story of the page, long enough to be read.\nAnd more of it."
    for wrapper in ("class='content no-sidebar'", "id='content' class='has-sidebar'", "class='page with-header'", "class=page--no-ads", "class='modal'", "id=side"):
        assert text(f"<body><div {wrapper}><article>{story}</article></div></body>") == want
        assert text(f"<body><nav>menu</nav><div {wrapper}>{story}</div></body>") == want
        assert text(f"<body><div {wrapper}><main>{story}<div class='ad'>BUY</div></main><div class='sidebar'>aside</div></div></body>") == want
    for left_out in ("sidebar", "sidebar-left", "site-footer", "cookie-notice", "ad-slot-3", "ad2", "related-posts", "comments_list"):
        assert text(f"<body><article>{story}<div class='{left_out}'>other</div></article></body>") == want
    assert text(f"<body><article>{story}</article><div class='related'><article><p>{'card ' * 90}</p></article></div></body>").startswith("The story")


def text(s):
    page = h.parse(s)
    return h.text_at(page, h.best(page)[0])


def test_quotes_in_attributes():
    """A quote opens a value only after an equals sign."""
    assert text("<p data-x=it's>one</p><p>two</p><p>it's three</p>") == "one\ntwo\nit's three"
    assert text("""<article><p title='a>b' class=x">one</p><p a"b c='>d'>two</p><p id=q data-class="ad">three</p></article>""") == "one\ntwo\nthree"
    assert text("a < b <c") == "a < b <c" and text("<p>x<!-- never ends <p>y") == "x"


def test_text_beside_the_best_container():
    long_text = "long text of the story " * 30
    assert text(f"<body><div class=a><div class=b><p>{long_text}</p></div><div class=c><p>{long_text[:200]}</p></div></div></body>").endswith("\n" + long_text[:200].strip())
    assert text(f"<body><div class=a>before<div class=b><p>{long_text}</p></div>after</div><div class=ad>x</div></body>") == f"before\n{long_text.strip()}\nafter"


def test_nested_comments_and_lines():
    story = "<p>The story of the page.</p><p>And more of it.</p>"
    want = "The story of the page.\nAnd more of it."
    assert text(f"<body><article class=post>{story}<article class=comment><p>A reader</p></article></article></body>") == want
    assert text("<article class=comment><p>a page of one comment</p></article>") == "a page of one comment"
    assert text(f"<article><p class=alert>Mind this.</p><div class=legal><p>So be it.</p></div>{story}</article>") == f"Mind this.\nSo be it.\n{want}"
    assert text("<article><p>Let <math><mi>x</mi></math> be <svg><text>no</text></svg><button>B</button>and <select><option>o<option>p</select>end</p></article>") == "Let x be and end"


def test_deep_nesting():
    """100,000 elements in one another, in time and memory that grow with the page."""
    n = 100_000
    assert text("<div class=a1>" * n + "<p>deep</p>" + "</div>" * n) == "deep"
    assert text("<div>x" * n + "</b>" * n).count("\n") == n - 1
    assert text("<article><p>q</p>" + "<div class=ad>x" * n) == "q"
    assert text("<a" * n) == ""


@pytest.mark.parametrize("inner", ['<h2 id="navigation">Navigation</h2>', '<h2 id="comments">Comments</h2>', '<h2 id="related">Related</h2>', '<h1 id="header">Header</h1>', '<p class="social">Social words.</p>', '<section id="search"><h2>Search</h2><p>How to.</p></section>', '<table><tr><th class="header">Head</th><td class="ad-1">cell</td></tr></table>', "<p>A <label>word</label> here</p>"])
def test_names_do_not_take_content(inner):
    """Ids made from a heading's words, classes of cells and lines, sections of an article, labels inside a sentence."""
    want = [x.strip() for x in h.re.sub(r"</?(?:label|b)>", "", inner).replace("><", ">\n<").split("\n")]
    want = [y for y in (h.re.sub("<[^>]*>", "", x).strip() for x in want) if y]
    assert text(f"<body><nav>menu</nav><article><p>Before it.</p>{inner}<p>After it.</p></article><div class=sidebar>x</div></body>") == "\n".join(["Before it.", *want, "After it."])
    assert text("<article><p>So it is.</p><section id=comments><p>A reader</p></section><section class=related><p>Card</p></section></article>") == "So it is."


def test_little_text_and_titles_stay():
    """A lead or title of a few words beside a long text, in its wrapper, or beside an article in main."""
    long_text = ("long text of the story " * 60).strip()
    assert text(f'<body><div class="wrap"><div class="lead"><p>Lead paragraph.</p></div><div class="text"><p>{long_text}</p></div></div></body>') == f"Lead paragraph.\n{long_text}"
    assert text(f'<body><div class="t"><h1>Title</h1></div><div class="c"><p>{long_text}</p></div></body>') == f"Title\n{long_text}"
    assert text(f"<body><main><h1>Title</h1><article><p>{long_text}</p></article></main></body>") == f"Title\n{long_text}"
    assert text(f"<body><div class=w><h1>Title</h1><article><p>{long_text}</p></article></div><p>site</p></body>") == f"Title\n{long_text}"
    assert text(f"<body><h1>Site</h1><article><p>{long_text}</p></article></body>") == long_text
    assert text(f"<body><h1>Site</h1><article><h1>Title</h1><p>{long_text}</p></article></body>") == f"Title\n{long_text}"


@pytest.mark.parametrize("seed", range(40))
def test_generated_pages(seed):
    """Pages built from a known article: random wrappers, sibling divs, boilerplate, unclosed tags, nested comments."""
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice("one two three four five six seven eight nine ten".split()) for _ in range(n))
    quote = lambda v: rng.choice([f'"{v}"', f"'{v}'", v])
    blocks = [say(rng.randint(15, 60)) for _ in range(rng.randint(3, 9))]
    boiler = lambda: rng.choice([
        f"<nav><ul><li><a href=/x>{say(3)}</a><li>{say(1)}</ul></nav>", f"<div class={quote('cookie-notice')}>{say(30)}</div>", f"<aside>{say(40)}</aside>", f"<div id={quote('sidebar-2')}><p>{say(50)}</div>",
        f"<footer>{say(20)}</footer>", f"<script>var a='<p>{say(9)}</p>'</script>", f"<form>{say(5)}<input value='>'></form>", f"<!-- {say(5)} <p> -->", f"<style>p{{}}</style>", f"<div class={quote('ad')}>{say(12)}</div>",
    ])
    parts = []
    for x in blocks:
        kind = rng.randrange(4)
        at = rng.randrange(len(x.split()))
        w = [f"<b title=it's>{w}</b>" if k == at else w for k, w in enumerate(x.split())]
        parts.append({0: f"<p>{' '.join(w)}", 1: f"<p class={quote('x')}>{' '.join(w)}</p>", 2: f"<div class=c{rng.randrange(9)}><p>{' '.join(w)}</p></div>", 3: f"<ul><li>{' '.join(w)}</ul>"}[kind])
        if rng.random() < 0.4:
            parts.append(boiler())
    inner = "\n".join(parts) + (f"<article class=comment>{say(30)}</article>" if seed % 3 == 0 else "")
    wrap = rng.choice(["<article>%s</article>", "<main><article class='post no-sidebar'>%s</article></main>", "<main class=with-header>%s</main>", "<div class='page has-sidebar'><div class=inner>%s</div></div>"])
    if "article" not in wrap and seed % 3 == 0:
        wrap = f"<article>{wrap}</article>"
    page = f"<html><body class=home>{boiler()}{boiler()}{wrap % inner}{boiler()}{boiler()}</body></html>"
    assert text(page) == "\n".join(blocks)
