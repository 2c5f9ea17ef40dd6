from skeinbase.llm import html

PAGE = """<!doctype html><html><head><title>Site</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="post header-fixed"><header>Logo</header><nav><ul><li><a href=/>One</a><li>Two</ul></nav><div id="cookie-notice">We use cookies</div>
<article><h1>Big &amp; small</h1><p>First  para
 with <b>bold</b>ly words<br>and a break<p>Second para has <a href=x>a link</a> in it &copy; 2024
<div class="ad-box">Buy now</div><ul><li>item one<li>item two</ul><form>name <input></form></article>
<section class="comments"><p>I liked it very much and write a long comment about all of it here</p></section><aside>more</aside><footer>&copy; us</footer></body></html>"""
TEXT = "Big & small\n\nFirst para with boldly words and a break\n\nSecond para has a link in it © 2024\n\nitem one\n\nitem two"


def weights():
    return html.weights_from(html.feature_counts(PAGE))


def test_main_text_of_a_page():
    assert html.main_text(PAGE, weights()) == TEXT
    assert html.main_text(PAGE, html.Weights()) == TEXT
    assert html.main_text(PAGE.replace("article", "div"), weights()) == TEXT


SITE = """<html><body><div class="zqa">Menu {i} of things</div><div class="intro">A teaser {i}.</div>
<article><h1>Title {i}</h1><p>{body}</p><p>{body} again.</p></article><div class="zqb"><a href=/x>Go {i}</a> <a href=/y>there</a></div></body></html>"""


def test_weights_are_learned_from_pages_that_mark_their_text():
    """Class words that no list has; the same site without marks afterwards."""
    from collections import Counter

    counts = Counter()
    for i in range(40):
        counts.update(html.feature_counts(SITE.format(i=i, body="some words of text " * 9)))
    learned = html.weights_from(counts)
    page = SITE.format(i=99, body="other words of text " * 12).replace("article", "div")
    assert html.main_text(page, learned).split()[:4] == ["Title", "99", "other", "words"]
    assert html.main_text(page, learned).endswith("again.")
    assert learned.around[".zqa"] < -4 and learned.around[".zqb"] < -3


def test_the_scan_decides_what_no_element_tells():
    """Words that score positive, but less than the tags between them and the text cost."""
    text = "<p>" + "words of the main text " * 10 + "</p><p>" + "and more of it " * 10 + "</p>"
    strays = "".join(f"<div><span><i>stray {i}</i></span></div>" for i in range(5))
    found = html.pieces(f"<body>{strays}<div>{text}</div>{strays}</body>")
    w = html.Weights()
    assert all(w.of(p) > 0 and not w.out(p) for p in found if p.kind == "word" and p.text.strip())
    got = html.main_text(f"<body>{strays}<div>{text}</div>{strays}</body>", w)
    assert got.startswith("words of the main") and got.endswith("more of it") and "stray" not in got


def test_pages_cut_off_anywhere():
    for i in range(len(PAGE)):
        html.main_text(PAGE[:i], weights())
    assert html.main_text("<p>cut &am", weights()) == "cut &am" and html.main_text("<p>cut <a hre", weights()) == "cut"


def test_best_region_is_that_of_brute_force():
    import random

    rng = random.Random(0)
    for _ in range(200):
        s = [rng.choice([-2.0, -1.0, -0.5, 0.0, 1.0, 2.0]) for _ in range(rng.randint(0, 12))]
        a, b = html.best_region(s)
        most = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        assert sum(s[a:b]) == max(0, most)


def test_rows(spark):
    rows = [(1, "u1", PAGE), (2, "u2", None), (3, None, ""), (None, "u4", "<p>text"), (1, "u1", PAGE), (5, "u5", "no tags at all"), (6, "u6", "<nav>menu only</nav>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = html.extract_text(pages, keep=("url",))
    assert sorted(map(str, found.collect())) == sorted(map(str, [type(found.first())(id=i, text=t, url=u) for i, u, t in [(1, "u1", TEXT), (2, "u2", ""), (3, None, ""), (None, "u4", "text"), (1, "u1", TEXT), (5, "u5", "no tags at all"), (6, "u6", "")]]))
    assert html.extract_text(pages.limit(0)).collect() == []


BODY = "<p>" + "words of the text itself " * 8 + "</p>"


def test_an_element_that_holds_the_text_is_not_dropped_for_its_name():
    page = f'<body><nav>One Two</nav><div id="main-menu-content"><div class="sidebar"><article><h1>The head of it</h1>{BODY}</article></div></div></body>'
    for w in (html.Weights(), weights()):
        assert html.main_text(page, w).startswith("The head of it\n\nwords of the text")
    bare = f'<body><nav>One Two</nav><div id="main-menu-content"><h1>The head of it</h1>{BODY}</div></body>'
    assert html.main_text(bare, weights()).startswith("The head of it\n\nwords of the text")


def test_the_heading_of_a_text_is_no_header_of_the_page():
    for head in ('<div class="article-header"><h1>Title of it</h1></div>', "<header><h1>Title of it</h1></header>", '<div class="post_header wide"><h1>Title of it</h1></div>'):
        page = f"<body><header>Logo of it</header><article>{head}{BODY}<footer>by us</footer></article><footer>all rights</footer></body>"
        got = html.main_text(page, weights())
        assert got.startswith("Title of it\n\nwords of the text") and "Logo" not in got and "rights" not in got and "by us" not in got


def test_weights_that_pages_teach_overrule_what_was_known_beforehand():
    """A site whose text is in elements of doubted names, and whose comments are in elements of no known name."""
    from collections import Counter

    site = '<body><div class="promo-story-box"><p>{more}</p></div><article><div class="widget">{body}</div></article><div class="reactions"><p>{more}</p></div></body>'
    counts = Counter()
    for i in range(60):
        counts.update(html.feature_counts(site.format(i=i, body=BODY * 3, more="I liked it " * 12)))
    learned = html.weights_from(counts)
    assert learned.around[".widget"] > 0 > html.doubt(".widget") and learned.around[".reactions"] < -4
    page = site.format(body=BODY * 2, more="they said so " * 9)
    for text in (page, page.replace("article", "div")):  # with and without marks
        got = html.main_text(text, learned)
        assert got.count("words of the text") == 16 and "they said" not in got


def test_pages_without_marks_give_what_pages_with_marks_teach():
    """Learned from one half of the pages; the other half loses its marks, and still gives the same text."""
    import random
    from collections import Counter

    rng = random.Random(1)
    words = "river stone quiet morning window garden letter paper yellow engine".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shape = "<body><div class=qa><a href=/>{a}</a> <a href=/>{b}</a></div><article><h1>{t}</h1>{p}</article><div class=qb><p>{c}</p></div><div><a href=/>{a}</a><a href=/>{b}</a></div></body>"
    pages = []
    for _ in range(120):
        title, paragraphs = say(4), [say(rng.randint(10, 60)) for _ in range(rng.randint(1, 6))]
        page = shape.format(a=say(2), b=say(2), c=say(15), t=title, p="".join(f"<p>{x}</p>" for x in paragraphs))
        pages.append((page, "\n\n".join([title, *paragraphs])))
    counts = Counter()
    for page, _ in pages[::2]:
        counts.update(html.feature_counts(page))
    learned = html.weights_from(counts)
    for page, text in pages[1::2]:
        assert html.main_text(page.replace("article", "section"), learned) == text
