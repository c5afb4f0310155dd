import random

import pytest

from rankmill.llm.page_text import Wrapper, extract_main_text, infer_wrappers, main_text, parse


def text_of(*pages):
    wrapper = Wrapper()
    for page in pages:
        wrapper.join(Wrapper.of_page(parse(page)))
    return [main_text(parse(page), wrapper) for page in pages]


FRAME = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
<body class="no-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li>More</ul></nav>
<div class="cookie-notice">We use cookies</div><div id="content-sidebar-wrap"><aside>side</aside><!-- <p>gone</p> -->
<article class="post"><header class="entry-header"><h1>Title</h1></header>%s
<form><p>Mail</p><input name=q></form><div class="ad banner">Buy</div><section id="comments"><p>I disagree</p></section>
<footer>by me</footer></article><article class="comment">me too</article></div><footer>&copy; me</footer></body></html>"""


def test_blocks_of_the_article():
    body = "<p>One <b>two</b>,\n  three&nbsp;&eacute;&#233;<br>four<p>five<ul><li>six<li>seven</ul>tail <a href='x>y'>a &lt; b</a> 1 < 2"
    assert text_of(FRAME % body) == ["Title\nOne two, three éé four\nfive\nsix\nseven\ntail a < b 1 < 2"]


@pytest.mark.parametrize("page", [None, "", "   ", "plain", "<", "<p", "<article", "<!--", "<script>", "</div></p>", "<article></article>", "&", "<div " + "a" * 3000])
def test_broken_pages_do_not_fail(page):
    assert text_of(page) == ["plain" if page == "plain" else "<" if page == "<" else "&" if page == "&" else ""]


def test_deep_and_cut_pages():
    assert text_of("<div>" * 5000 + "<article><p>x &am") == ["x &am"]
    assert text_of("<article><p>one</p><p>two <b", '<article><p>x</p><p class="y') == ["one\ntwo", "x"]


def test_deep_elements_are_seen():
    deep = "<div>" * 200
    inside = f"<article><p>one</p>{deep}<section><nav>menu</nav><div>two</div></section>{'</div>' * 200}<p>three</p></article><p>no</p>"
    assert text_of(f"<body>{inside}</body>", f"<body>{deep}<aside>x</aside>{inside}") == ["one\ntwo\nthree"] * 2
    assert text_of(f"<article>{deep}<article>two</article><p>three</p></article>") == ["two\nthree"]
    pages = [f"<p>Site</p>{'<div>' * 3000}<h3>{i}</h3><p>own {i}</p>" for i in range(6)]
    wrapper = Wrapper()
    for page in pages:
        wrapper.join(Wrapper.of_page(parse(page)))
    assert Wrapper.loads(wrapper.dumps()).dumps() == wrapper.dumps()
    assert main_text(parse(pages[4]), Wrapper.loads(wrapper.dumps())) == "4\nown 4"


def test_pages_without_an_article_go_by_the_wrapper():
    def page(i):
        words = " ".join(f"w{i}x{k}" for k in range(60))
        return (
            f'<html><body><div class="x1"><p>Welcome to our pages</p></div><div class="story"><h2>Head {i}</h2><p>{words}</p>'
            f'<p>All rights reserved by us</p></div><div class="y"><p>Contact us</p><p>Number {i}</p></div></body></html>'
        )

    got = text_of(*[page(i) for i in range(6)])
    assert got[2] == "Head 2\n" + " ".join(f"w2x{k}" for k in range(60))


def test_a_form_around_the_page_keeps_the_article():
    page = "<body><form id=f><div class='header'>Top</div><article><p>text</p><form><p>Mail</p></form></article></form></body>"
    assert text_of(page) == ["text"]


def test_headings_stay_with_their_text():
    words = " ".join(f"w{k}" for k in range(80))
    page = f"<body><header>Top</header><div class=c><div><h1>Head</h1><div class=b><p>{words}</p></div></div></div><div>x</div></body>"
    assert text_of(page) == [f"Head\n{words}"]
    assert text_of("<main><header><h1>Head</h1></header><p>text</p></main><footer>x</footer>") == ["Head\ntext"]


def test_copies_keep_their_text():
    assert text_of(*["<article><p>same</p></article>"] * 9) == ["same"] * 9


@pytest.mark.parametrize("n", [4, 5, 9])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_what_all_articles_say_stays(n, tag):
    pages = [f"<body><p>Site</p><{tag}><p>same</p><p>own {i}</p><h2>Conclusion</h2><p>shared</p></{tag}></body>" for i in range(n)]
    assert text_of(*pages) == [f"same\nown {i}\nConclusion\nshared" for i in range(n)]


def test_a_region_without_an_article_keeps_shared_texts_between_its_own():
    words = " ".join(f"w{k}" for k in range(60))
    pages = [f"<div><p>Site</p><p>{i} {words}</p><h3>Conclusion</h3><p>shared</p><p>end {i}</p><p>Us</p></div>" for i in range(6)]
    assert text_of(*pages)[3] == f"3 {words}\nConclusion\nshared\nend 3"


def random_page(rng):
    def part(depth):
        tag = rng.choice(["div", "p", "ul", "section"])
        inner = "".join(part(depth - 1) for _ in range(rng.randrange(4))) if depth else ""
        return f'<{tag} class="{rng.choice("ab")}">{rng.choice(["same", str(rng.random())])}{inner}</{tag}>'

    return f"<body>{part(3)}{part(2)}</body>"


def accepts(wrapper, element):
    """The page's children follow the wrapper's expression."""
    at = 0
    for kid in element.kids:
        if isinstance(kid, str):
            continue
        while at < len(wrapper.order) and kid.sign not in wrapper.order[at]:
            at += 1
        if at == len(wrapper.order) or not accepts(wrapper.kids[kid.sign], kid):
            return False
    return True


def test_wrappers_accept_their_pages_in_any_grouping():
    rng = random.Random(8)
    for _ in range(60):
        pages = [random_page(rng) for _ in range(6)]
        halves = [Wrapper(), Wrapper()]
        for i, page in enumerate(pages):
            halves[i % 2].join(Wrapper.of_page(parse(page)))
        whole = Wrapper().join(Wrapper.loads(halves[0].dumps())).join(Wrapper.loads(halves[1].dumps()))
        one = Wrapper()
        for page in pages:
            one.join(Wrapper.of_page(parse(page)))
            assert accepts(one, parse(page))
        assert all(accepts(whole, parse(page)) for page in pages)
        assert (whole.n, whole.texts, set(whole.kids)) == (one.n, one.texts, set(one.kids))


def test_expression():
    pages = ["<article><h1>a</h1><p>b</p><p>c</p></article>", "<article><h1>d</h1><ul><li>e</li></ul><p>f</p></article>",
             "<article><p>x</p><ul><li>e</li></ul><p>f</p></article>"]
    wrapper = Wrapper()
    for page in pages:
        wrapper.join(Wrapper.of_page(parse(page)))
    assert wrapper.expression() == "# <article># <h1>#</h1>? (<ul># <li>#</li></ul>? <p>#</p>+)+</article>"


def test_list_pages(spark):
    rows = [("h", 1, "u1", FRAME % "<p>x y</p>", 4), ("h", 1, "u1", FRAME % "<p>x y</p>", 4), (None, 2, None, None, 4), ("g", None, "u2", "", 4)]
    pages = spark.createDataFrame(rows, "list_key string, page_id int, url string, html string, text int")
    got = sorted((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in extract_main_text(pages).collect())
    assert got == [(0, "u2", "", 0), (1, "u1", "Title\nx y", 9), (1, "u1", "Title\nx y", 9), (2, None, "", 0)]
    assert {r["list_key"]: Wrapper.loads(r["wrapper"]).n for r in infer_wrappers(pages).collect()} == {"h": 2, "": 1, "g": 1}
    assert extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "part",
    [
        '<h2 id="discussion">Kept</h2>', '<h2 id="search">Kept</h2>', '<h3 class="related">Kept</h3>', '<p id="feedback">Kept</p>',
        '<p class="notice">Kept</p>', '<div class="social">Kept</div>', '<section id="discussion-2">Kept</section>', '<li class="alert">Kept</li>',
        '<section id="search-algorithms"><p>Kept</p></section>', '<blockquote class="promo">Kept</blockquote>',
        '<table class="results"><tr><td class="notice">Kept</td></tr></table>',
    ],
)
def test_names_take_no_text_out_of_an_article(part):
    assert text_of(f"<article><p>one</p>{part}<p>two</p></article>") == ["one\nKept\ntwo"]


@pytest.mark.parametrize(
    "part",
    [
        '<div class="ad">x</div>', '<section class="comments"><p>x</p></section>', '<div class="social-share">x</div>', "<form>x</form>",
        '<div class="related-posts"><a>x</a></div>', '<aside>x</aside>', '<div id="comments">x</div>', '<ul class="breadcrumbs"><li>x</ul>',
    ],
)
def test_what_is_no_article_goes_from_inside_it(part):
    assert text_of(f"<article><p>one</p>{part}<p>two</p></article>") == ["one\ntwo"]


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9])
def test_the_size_of_a_list_changes_nothing(n):
    words = " ".join(f"w{k}" for k in range(60))
    pages = [f"<div><p>Site</p><p>{i} {words}</p><p>end {i}</p><p>Us</p></div>" for i in range(n)]
    assert text_of(*pages) == [f"{i} {words}\nend {i}" for i in range(n)]


def plain_text(page):
    """Blocks of an article whose markup is well formed and holds paragraphs, headings, lists and dropped parts only."""
    import html
    import re

    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    body = re.sub(r'<(nav|aside|form|script)>.*?</\1>|<div class="(?:ad|comments|share-bar)">.*?</div>|<!--.*?-->', "\n\x00", body, flags=re.S)
    body = re.sub(r"</?(?:p|h2|li|ul|section|div)\b[^>]*>|<br>", "\x00", body)
    body = re.sub(r"</?(?:b|i|a)\b[^>]*>", "", body)
    blocks = (" ".join(html.unescape(x).split()) for x in body.split("\x00"))
    return "\n".join(x for x in blocks if x)


@pytest.mark.parametrize("seed", range(30))
def test_made_up_pages_match_a_plain_version(seed):
    rng = random.Random(seed)

    def words():
        return " ".join(rng.choice(["one", "é&eacute;", "a<b>b</b>", "1 &lt; 2", "&#233;", "\n x", "<i>it</i>"]) for _ in range(rng.randrange(1, 8)))

    def part():
        kind = rng.randrange(6)
        if kind == 0:
            return "<ul>" + "".join(f"<li>{words()}</li>" for _ in range(3)) + "</ul>"
        if kind == 1:
            return rng.choice([f"<nav>{words()}</nav>", f"<aside><p>{words()}</p></aside>", f'<div class="ad">{words()}</div>', "<script>x<p></script>"])
        if kind == 2:
            return f'<section id="search"><h2 class="notice">{words()}</h2><p>{words()}</p></section>'
        return f"<p>{words()}</p>" if kind < 5 else f'<div class="social">{words()}</div>'

    pages = [f"<html><body><nav>menu</nav><article>{''.join(part() for _ in range(rng.randrange(1, 9)))}</article><footer>f</footer></body></html>" for _ in range(rng.randrange(1, 7))]
    assert text_of(*pages) == [plain_text(page) for page in pages]
