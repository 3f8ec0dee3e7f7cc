"""Pages from random trees, whose main text the tree itself gives, and single cases."""

from __future__ import annotations

import random

import pytest

from clientele.llm import html_text

LONG = "A long sentence of prose that goes on and on, with commas, and reads like an article would read."
SKIPPED = [
    "<script>var a='<p>x';</script>", "<style>p{}</style>", "<svg><text>dd</text></svg>", "<button>b</button>", "<span class='ad'>ad</span>", "<a class='share'>s</a>", "<select><option>o<option>n</select>",
    "<textarea>t</textarea>", "<canvas>c</canvas>", "<noscript>n</noscript>", "<!-- remark -->", "<iframe>i</iframe>", "<video>v</video>", "<span class='newsletter-signup'>w</span>",
]
WRAPPERS = [
    "{}", "<form id=aspnet>{}</form>", "<div class='has-sidebar no-comments'>{}</div>", "<div class='post-with-sidebar'>{}</div>", "<div class='page-header-fixed'>{}</div>", "<div class='topic social'>{}</div>",
    "<div id=content class=search>{}</div>", "<main>{}</main>", "<div class=header>{}</div>", "<center><table><tr><td>{}</td></tr></table></center>",
]
JUNK = [
    "<nav><ul><li><a href=/a>Home</a><li><a>News</a></ul></nav>", "<div class='cookie-notice'><p>We use cookies.</p></div>", f"<aside><p>{LONG}</p></aside>", "<div class=ad>Buy now</div>",
    f"<section class='comments'><article><p>{LONG * 3}</p></article></section>", "<form><input><label>Your name</label></form>", "<div class='site-footer'><a>About</a> <a>Legal</a></div>",
    f"<div id=related><p>{LONG}</p></div>", "<ul class=breadcrumb><li>a<li>b</ul>",
]


class Page:
    """A random page and its main text, built side by side."""

    def __init__(self, rng):
        self.rng, self.blocks = rng, []
        count = rng.choice([1, 1, 1, 2, 4])
        articles = "".join(self.article(k) for k in range(count))
        wrapped = rng.choice(WRAPPERS).format(articles)
        junk = [rng.choice(JUNK) for _ in range(rng.randrange(5))]
        cut = rng.randrange(len(junk) + 1)
        self.html = f"<!DOCTYPE html><html><head><title>t</title><script>1<2</script></head><body class='no-js'>{JUNK[0]}{''.join(junk[:cut])}{wrapped}{''.join(junk[cut:])}<footer>foot</footer></body></html>"

    def article(self, k):
        out = ""
        if self.rng.random() < 0.5:
            self.blocks.append(f"Title {k}")
            out += f"<header><h1>Title {k}</h1><p>By somebody</p></header>"
        for _ in range(self.rng.randrange(2, 6)):
            out += self.block()
        self.blocks.append(LONG)
        out += f"<p>{LONG}</p>"
        return f"<article>{out}</article>"

    def block(self):
        kind = self.rng.choice(["p", "p", "open", "h2", "list", "quote", "junk"])
        if kind == "junk":
            return self.rng.choice(["<aside>more</aside>", "<div class='share social'><a>f</a></div>", "<figure><img src=a></figure>"])
        if kind == "list":
            items = [self.words(self.rng.randrange(1, 5)) for _ in range(self.rng.randrange(1, 4))]
            self.blocks += items
            return "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
        parts, text = "", []
        for _ in range(self.rng.randrange(1, 4)):
            words = LONG if self.rng.random() < 0.7 else self.words(3)
            text.append(words)
            parts += self.rng.choice(["{}", "<b>{}</b>", "<i> {} </i>", "<a href=x>{}</a>"]).format(words) + self.rng.choice(["", "<br>", " "]) + (self.rng.choice(SKIPPED) if self.rng.random() < 0.4 else "") + " "
        self.blocks.append(" ".join(text))
        tag = {"open": "p", "quote": "blockquote"}.get(kind, kind)
        return f"<{tag}>{parts}" + ("" if kind == "open" else f"</{tag}>")

    def words(self, n):
        return " ".join(self.rng.choice(["one", "two", "three", "é"]) for _ in range(n))


def test_pages_from_random_trees():
    rng = random.Random(7)
    for _ in range(1500):
        page = Page(rng)
        assert html_text.main_text(page.html) == "\n".join(page.blocks), page.html


@pytest.mark.parametrize("skipped", SKIPPED)
def test_text_around_skipped_pieces_stays_one_line(skipped):
    page = f"<html><body>{JUNK[0]}<article><p>{LONG} stands before {skipped} and goes on after.</p></article><footer>f</footer></body></html>"
    assert html_text.main_text(page) == f"{LONG} stands before and goes on after."


def test_pages_without_landmarks():
    body = f"<p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
    want = f"{LONG}\nShort.\n{LONG}"
    for page in (f"{JUNK[0]}<div>{body}</div><div class=comments><p>{LONG * 9}</p></div>", f"{JUNK[0]}<form>{body}</form><footer>f</footer>", f"{JUNK[0]}<div class=sidebar>{body}</div><footer>f</footer>"):
        assert html_text.main_text(page) == want, page
    assert html_text.main_text(f"<div class=comments><p>{LONG}</p></div>") == ""
    assert html_text.main_text("<article><p>a<math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p></article>") == "ax=1 b"


def test_odd_pages(spark):
    long = "<article>" + f"<p>{LONG}</p>" * 20000 + "</article>"
    rows = [(1, "u", long), (2, None, None), (2, None, None), (3, "v", "<div>" * 3000 + "deep"), (4, "w", "&amp;&#233;&nbsp;x &bogus; &#0;"), (4, "w", "plain, no tags"), (None, "x", "<p")]
    df = spark.createDataFrame([(*r, "t", 5, 0) for r in rows], "page_id long, url string, html string, text string, n_chars int, state int")
    found = html_text.extract(df).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in found) == sorted((str(i), len(html_text.main_text(h)) if h else 0) for i, _, h in rows)
    assert next(r for r in found if r.page_id == 1).text == "\n".join([LONG] * 20000)
    assert [r.text for r in found if r.page_id == 3] == ["deep"]
    empty = html_text.extract(df.limit(0))
    assert empty.collect() == [] and empty.columns == ["page_id", "url", "text", "n_chars"]
