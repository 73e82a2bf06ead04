"""HTML attributes, wrappers and unclosed elements; pages made by rule against a parser of the standard library."""

import random
from html import escape
from html.parser import HTMLParser

import pytest

from symgraph.llm.html import attributes, extract_text

LONG = "The whole text of the article stands here, in one paragraph that is long enough to count."


@pytest.mark.parametrize("html", [
    '<div style="overflow: hidden"><p>{}</p></div>', '<article><p title="The hidden cost">{}</p></article>', '<article><p aria-hidden="false">{}</p></article>',
    "<article><p><span data-hidden=0>{}</span></p></article>", '<div data-id="comments"><p>{}</p></div>', '<div title="class=comments id=nav hidden"><p>{}</p></div>',
    "<div data-class='menu'><p>{}</p></div>", '<div style="background:url(x;display:none.png)"><p>{}</p></div>', '<div class=post data-x=hidden><p>{}</p></div>',
    '<form id="aspnetForm" action="./"><header>Site</header><div><h1></h1><p>{}</p></div><footer>Imprint</footer></form>', '<body><nav><a href="/">Home</a><article><p>{}</p></article></body>',
    "<body><aside>Teasers<main><p>{}</p></main></body>", '<article><div class="comment"><p>{}</p></div></article>', "<body><header>Name<nav><a href=/>x</a><main><p>{}</p></main>",
])
def test_kept(html):
    assert extract_text(f"<html>{html.format(LONG)}</html>") == LONG


@pytest.mark.parametrize("part", [
    "<p hidden>no</p>", '<div hidden="hidden">no</div>', '<div style="display:none">no</div>', "<p style='color:red; DISPLAY : none !important'>no</p>", '<div style="visibility: hidden;">no</div>',
    '<div id="disqus_thread">no</div>', '<form action="/s"><label>no</label><p>no</p><input></form>', "<div class=\"comments\">no</div>", '<span style="display:&#110;one">no</span>', '<DIV CLASS="Cookie-Notice">no</DIV>',
])
def test_left_out(part):
    assert extract_text(f"<html><body><article><p>{LONG}</p>{part}</article></body></html>") == LONG


def test_pages_of_forms_alone_are_empty():
    assert extract_text('<html><body><form action="/in"><label>Name</label><input><label>Password</label></form></body></html>') == ""


def test_attribute_parsing():
    assert attributes(' a="1 b=2" b=\'x "y"\' C=3 d e = f  g="" a=9 h=&amp; /') == {"a": "1 b=2", "b": 'x "y"', "c": "3", "d": "", "e": "f", "g": "", "h": "&"}


class Plain(HTMLParser):
    """Text of a page without what is hidden or skipped, by a stack of elements (all of them closed)."""

    def __init__(self):
        super().__init__()
        self.stack, self.out = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(reversed(attrs))
        style = "".join((a.get("style") or "").split()).lower().split(";")
        if tag not in ("br", "img"):
            self.stack.append(tag in ("nav", "footer", "script") or "hidden" in a or "display:none" in style)
        if tag not in ("b", "span", "i", "img"):
            self.out.append("\0")

    def handle_endtag(self, tag):
        self.stack.pop()
        if tag not in ("b", "span", "i"):
            self.out.append("\0")

    def handle_data(self, data):
        if not any(self.stack):
            self.out.append(data)


VALUES = ["hidden", "class=nav", "The hidden cost", "display: none", "a > b", 'say "hidden"', "it's", "", "comments", "overflow:hidden", "/hidden-gems"]
NAMES = ["title", "data-hidden", "aria-hidden", "data-id", "alt", "href", "data-class", "lang", "onclick", "xhidden", "hidden-x"]


def made(rnd, attributes_of):
    parts = []
    for k in range(rnd.randint(2, 7)):
        words = " ".join(rnd.choice(["alpha", "beta", "&amp;", "gamma", "&eacute;", "delta"]) for _ in range(rnd.randint(4, 20)))
        shut = rnd.random() < 0.2
        unseen = rnd.choice([" hidden", ' style="color: red; display: none"', " HIDDEN=''"]) if shut else ""
        inner = f"{words} <b{attributes_of()}>bold {k}</b> <span{attributes_of()}>and more</span>"
        parts.append(f"<p{attributes_of()}{unseen}>{inner}</p>" if rnd.random() < 0.7 else f"<h2{attributes_of()}{unseen}>{inner}</h2><nav{attributes_of()}>menu {k}</nav>")
    return f"<html><body><article{attributes_of()}>{''.join(parts)}<p>the end of it</p></article><footer{attributes_of()}>foot</footer></body></html>"


def quoted(rnd):
    def one():
        v = rnd.choice(VALUES)
        return f"{rnd.choice(NAMES)}={rnd.choice([chr(34) + escape(v) + chr(34), chr(39) + escape(v) + chr(39)])}"

    return lambda: "".join(rnd.choice([" ", "\n"]) + one() for _ in range(rnd.randint(0, 3)))


def test_made_pages_against_a_parser():
    for seed in range(400):
        html = made(random.Random(seed), quoted(random.Random(-seed)))
        p = Plain()
        p.feed(html)
        want = " ".join(filter(None, (" ".join(x.split()) for x in "".join(p.out).split("\0"))))
        assert extract_text(html) == want, html


def test_values_never_change_the_text():
    for seed in range(300):
        bare = made(random.Random(seed), lambda: "")
        assert extract_text(made(random.Random(seed), quoted(random.Random(seed + 7)))) == extract_text(bare)
