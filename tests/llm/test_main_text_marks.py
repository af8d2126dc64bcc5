"""Main text: marks and hidden attributes, odd and hostile pages, and votes against a plain version."""

import random
import re
import time
import tracemalloc
from collections import Counter
from html.parser import HTMLParser

import pytest

from tracelake.llm import html_text

PROSE = "<p>" + "words of the article " * 10 + "</p>"
TEXT = " ".join(["words of the article"] * 10)


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="content-sidebar-wrap"><main>{PROSE}</main></div><div>Posted in news</div>',
        f'<body><div class="page has-sidebar"><div class="entry">{PROSE}</div><div class="widget">recent things</div></div>',
        f'<body><div class="header-less menu-open"><article>{PROSE}<section id="comments"><p>a reader</p></section></article></div>',
        f'<body><div style="display:none" id="app"><main>{PROSE}</main></div>',
        f'<body><div data-sidebar-hidden="false"><p>{TEXT}</p></div>',
        f'<body><div data-title="hidden gems" data-class="ad"><p>{TEXT}</p></div>',
        f'<body><div class="comments-open"><p>{TEXT}</p></div>',
    ],
)
def test_articles_in_marked_wrappers_stay(page):
    assert html_text.extract(page) == TEXT


@pytest.mark.parametrize(
    "page",
    [
        f'<main>{PROSE}</main><div class="sidebar">{"side words " * 90}</div><div hidden>{"x y " * 200}</div>',
        f'<article>{PROSE}</article><section id="comments"><article class="comment">{"said " * 900}</article></section>',
        f'<main>{PROSE}<section id="comments">{"said " * 900}</section></main>',
        f'<div class="entry">{PROSE}</div><div class="related"><article>a card</article></div><div aria-hidden="true">no</div>',
    ],
)
def test_boilerplate_still_goes(page):
    assert html_text.extract(f"<body>{page}") == TEXT


@pytest.mark.parametrize("attr", ['data-hidden="false"', 'title="The hidden valley"', 'class="commentary"', 'class="social-studies"', 'class="has-sidebar"', 'class="article-header"'])
def test_blocks_that_only_look_marked_stay(attr):
    assert html_text.extract(f"<body><article>{PROSE}<div {attr}><p>middle</p></div><p>end</p></article>") == f"{TEXT} middle end"


@pytest.mark.parametrize("attr", ['id="comments" width="5"', 'id="comments" data-video="x"', 'class="post-comments"', 'id="adBox2"', "class='x cookie-banner'", "role=navigation", 'itemprop="comment"', "hidden", 'style="color:red; display : none"'])
def test_marked_blocks_go(attr):
    assert html_text.extract(f"<body><article>{PROSE}<div {attr}><p>middle</p></div><p>end</p></article>") == f"{TEXT} end"


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<form id="whole"><div class="content">{PROSE}</div></form>', ""),
        (f'<form id="whole"><main>{PROSE}</main></form>', TEXT),
        (f'<form id="whole"><div>{PROSE * 3}</div></form>', " ".join([TEXT] * 3)),
        (f'<div class="content"><h1>Head</h1><div class="text">{PROSE}</div></div><div>foot</div>', f"Head {TEXT}"),
        (f'<div class="content"><div class="part">{PROSE}</div><p>between</p><div class="part">{PROSE}</div></div>', f"{TEXT} between {TEXT}"),
        (f"<article>{PROSE}<p>cut <a href='http://", f"{TEXT} cut"),
        (f"<article>{PROSE}<p>1 < 2 &amp;<b></b>amp; <span class=ad>buy <span>now</span> here</span>end", f"{TEXT} 1 < 2 &amp; end"),
        (f'<article>{PROSE}<p title="a>b" class=\'it"s\'>x</p><p don\'t>y</p></article>', f"{TEXT} x y"),
        ("<article><p><a href=x>only links</a></article>", "only links"),
        ("<nav><p>menu words</nav>", ""),
        ("<title>never closed<article><p>words</article>", "words"),
        (f'<article><h1>Short</h1><p>tiny</p><div class="related">{PROSE}</div></article><div class="widget">{PROSE * 9}</div>', "Short tiny"),
        (f'<div class="entry"><p>tiny</p></div><div class="sidebar">{PROSE * 9}</div>', "tiny"),
        (f'<main><h1>Head</h1><div class="widget">{PROSE}</div></main>', f"Head {TEXT}"),
        (f'<table><tr><td class="menu"><a href="x">m</a><td class="content"><h1>Head</h1>{PROSE}</table>', f"Head {TEXT}"),
    ],
)
def test_odd_pages(page, text):
    assert html_text.extract(page) == text


@pytest.mark.parametrize("attr", ['id="discussion"', 'id="responses"', 'class="widget-text"', 'class="feedback section"'])
def test_parts_of_an_article_by_either_name(attr):
    page = lambda inner: html_text.extract(f"<body><article>{PROSE}{PROSE}<section {attr}>{inner}</section><p>end</p></article>")
    assert page("<h2>What it means</h2><p>We found this.</p><p>And that.</p>") == f"{TEXT} {TEXT} What it means We found this. And that. end"
    for boilerplate in ("reader said", '<div class="c"><p>a</p></div><div class="c"><p>b</p></div>', "<p>say it</p><form><p>here</p></form>", '<p><a href="/x">one</a> <a href="/y">two</a></p>'):
        assert page(boilerplate) == f"{TEXT} {TEXT} end"
    assert html_text.extract(f"<body><div>{PROSE}{PROSE}</div><div {attr}><p>a reader</p></div>") == f"{TEXT} {TEXT}"


@pytest.mark.parametrize("attr", ['class="kommentare"', 'class="werbung"', 'id="commentaires"', 'class="fb-comments"', 'id="gpt-ad-1"', 'class="comments discussion"', 'class="discussion" hidden', 'class="widget" role="complementary"'])
def test_marks_in_other_words_go(attr):
    assert html_text.extract(f"<body><article>{PROSE}{PROSE}<div {attr}><p>middle</p></div><p>end</p></article>") == f"{TEXT} {TEXT} end"


HOSTILE = [
    ("<a ", 350_000, ""), ("<a ", 350_000, ">"), ('<a b=">" ', 100_000, ""), ("<a b='\"'>", 100_000, ""), ("<div>", 100_000, "x"), ("<div>x", 100_000, ""),
    (("<div>", "</p></section>"), 60_000, ""), (("<ul><li><ul>", "<div>", "<li></li>"), 60_000, ""), ("<title>", 100_000, ""), ("<p class=ad><span class=ad>", 40_000, ""),
    ("<!--", 200_000, ""), ("<td><tr>", 60_000, ""), ("<article><div class=widget>x", 40_000, ""),
]


def hostile(part, n, end):
    return ("".join(p * (1 if p.startswith("<ul>") else n) for p in part) if isinstance(part, tuple) else part * n) + end


def seconds(page):
    began = time.process_time()
    html_text.extract(page)
    return time.process_time() - began


@pytest.mark.parametrize("part, n, end", HOSTILE)
def test_hostile_pages_are_read_in_linear_time(part, n, end):
    once, twice = (min(seconds(hostile(part, k, end)) for _ in range(2)) for k in (n // 2, n))
    assert twice < 3 * once + 0.3


@pytest.mark.parametrize("part, n, end", HOSTILE)
def test_hostile_pages_are_read_in_linear_memory(part, n, end):
    page = hostile(part, n // 4, end)  # the tracer is slow; memory is in proportion
    tracemalloc.start()
    html_text.extract(page)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 50_000_000


class Plain(HTMLParser):
    """A tree by the standard library's parser, for well-formed pages without marks."""

    def __init__(self, page):
        super().__init__()
        self.top = self.at = {"tag": "", "path": "", "up": None, "kids": []}
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        words = sorted(set(re.findall("[a-z]+", dict(attrs).get("class") or "")))
        node = {"tag": tag, "path": self.at["path"] + "/" + ".".join([tag, *words]), "up": self.at, "kids": []}
        self.at["kids"].append(node)
        self.at = node

    def handle_endtag(self, tag):
        self.at = self.at["up"]

    def handle_data(self, data):
        self.at["kids"].append(data)


def strings(node):
    """The node's texts with the candidates above each, nearest first; footers and links left out."""
    for kid in node["kids"]:
        if isinstance(kid, str):
            up, chain = node, []
            while up:
                chain += [up] if up["tag"] in html_text._BONUS else []
                up = up["up"]
            yield kid, chain
        elif kid["tag"] != "footer":
            yield from strings(kid)


def plain_best(page):
    total = {}
    for text, chain in strings(Plain(page).top):
        for k, n in enumerate(chain):
            total[n["path"]] = total.get(n["path"], 0) + len(text.strip()) * html_text._BONUS[n["tag"]] * 0.75**k
    return max(total, key=total.get) if total else None


def plain_texts(pages):
    """Votes by host, then for each page the most voted winner, or one inside it, or the page's own best."""
    held, votes = Counter(), Counter()
    for host, page in pages:
        held.update({(host, n["path"]) for t, chain in strings(Plain(page).top) for n in chain if t.strip()})
        votes[host, plain_best(page)] += 1
    out = []
    for host, page in pages:
        won = {p for (h, p), v in votes.items() if h == host and v >= 2 and 2 * v > held[h, p]}
        texts = [(t, {n["path"] for n in chain}) for t, chain in strings(Plain(page).top)]
        here = set().union(*(paths & won for t, paths in texts if t.strip())) if texts else set()
        path = max(here, key=lambda p: votes[host, p], default=None)
        while here:
            inner = {p for p in here if p != path and p.startswith(path)}
            path, here = max(inner, key=lambda p: votes[host, p], default=path), inner
        path = path or plain_best(page)
        out.append(" ".join(" ".join(t for t, paths in texts if path in paths).split()))
    return out


def test_votes_equal_a_plain_version(spark):
    r = random.Random(3)
    words = lambda n: " ".join(r.choices(["red", "green", "blue", "grey"], k=n))
    para = lambda: f"<p>{words(r.randint(5, 30))}</p>"
    layouts = [
        lambda: f'<html><body><div class="wrap{r.randint(1, 9)}"><div class="entry">{para()}{para()}</div><div class="talk">{para()}</div></div><footer>{words(9)}</footer></body></html>',
        lambda: f'<html><body><div class="wrap"><div class="talk">{para() * r.randint(1, 4)}</div><div class="entry">{para()}</div></div></body></html>',
        lambda: f"<html><body>{para()}{para()}</body></html>",
        lambda: f'<html><body>{para()}<div class="story s{r.randint(1, 9)}">{para() * 9}</div>{para()}</body></html>',
        lambda: f"<html><body><main><section>{para()}</section><p>{words(3)}</p></main><div>{para()}</div></body></html>",
    ]
    pages = []
    for host, mix in {"one.example": (0, 0, 0, 1), "two.example": (2, 2, 2, 3), "three.example": (0, 2, 3, 4), "four.example": (4,)}.items():
        pages += [(host, layouts[r.choice(mix)]()) for _ in range(40)]
    df = spark.createDataFrame([(i, f"https://{h}/{i}", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    got = {x["page_id"]: x["text"] for x in html_text.main_text(df).collect()}
    want = plain_texts(pages)
    assert [got[i] for i in range(len(pages))] == want
    alone = [html_text.extract(p) for _, p in pages]
    assert sum(a != b for a, b in zip(alone, want)) > 3  # the votes matter
