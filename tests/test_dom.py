"""The tree builder, serializers, CSS and XPath, without Spark."""

from __future__ import annotations

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from domloom.dom.serialize import markdown, outer_html
from domloom.dom.tree import parse
from domloom.selection import css, xpath
from domloom.selection.api import clean, find_all, find_by_regex, find_by_text

from .pages import BOARD, DIARY

T = parse(BOARD)


def C(selector, tree=T):
    return [tree.tag[i] if v is None else v for i, v in css.results(tree, css.parse_css(selector))]


def X(selector, tree=T, **variables):
    return [tree.tag[i] if v is None else v for i, v in xpath.results(tree, selector, 0, variables)]


@pytest.mark.parametrize(
    "html, shape",
    [
        ("", [("html", -1)]),
        ("  \x00 ", [("html", -1)]),
        ("<p>a<p>b", [("html", -1), ("body", 0), ("p", 1), ("p", 1)]),
        ("<p>x<b>y<p>z</b>w", [("html", -1), ("body", 0), ("p", 1), ("b", 2), ("p", 1)]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", [("html", -1), ("body", 0), ("ul", 1), ("li", 2), ("li", 2), ("ul", 4), ("li", 5), ("li", 2)]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", [("html", -1), ("body", 0), ("table", 1), ("tr", 2), ("td", 3), ("td", 3), ("tr", 2), ("td", 6)]),
        ("<title>t</title><p>x", [("html", -1), ("head", 0), ("title", 1), ("body", 0), ("p", 3)]),
        ("a<br/>b</br>c", [("html", -1), ("body", 0), ("br", 1)]),
        ("<select><option>a<option>b</select>", [("html", -1), ("body", 0), ("select", 1), ("option", 2), ("option", 2)]),
        ("<dl><dt>a<dd>b<dt>c</dl>", [("html", -1), ("body", 0), ("dl", 1), ("dt", 2), ("dd", 2), ("dt", 2)]),
    ],
)
def test_shapes(html, shape):
    t = parse(html)
    assert list(zip(t.tag, t.parent, strict=True)) == shape


def test_raw_text_entities_and_attributes():
    t = parse("<p a=1 A=2 b='x &amp; y' c>1 &lt; 2<script>var t = '</p>' && 1;</script>z</p><textarea><b>&amp;</textarea>")
    p = t.tag.index("p")
    assert t.attrs(p) == {"a": "1", "b": "x & y", "c": ""}
    assert t.text[p] == "1 < 2"
    assert t.text[t.tag.index("script")] == "var t = '</p>' && 1;"
    assert t.tail[t.tag.index("script")] == "z"
    assert t.text[t.tag.index("textarea")] == "<b>&"


def test_comments_and_cdata():
    assert "slugs" not in outer_html(parse(DIARY))
    assert "<!-- slugs -->" in outer_html(parse(DIARY, keep_comments=True))
    assert parse("<p>a<![CDATA[b]]>c</p>").string(0) == "ac"
    assert parse("<p>a<![CDATA[b]]>c</p>", keep_cdata=True).string(0) == "abc"
    assert parse("<p>a<!-- never closed").string(0) == "a"
    with pytest.raises(TypeError):
        parse(3)


def test_deep_nesting_is_iterative_and_quick():
    began = time.process_time()
    t = parse("<html><body>" + '<div class="item">' * 5000 + "</div>" * 5000)
    assert C(".item::text", t) == []
    assert len(C(".item", t)) == 5000
    assert time.process_time() - began < 0.5


@pytest.mark.parametrize(
    "selector",
    ["div div div div div p", "div ~ p ~ p", "p:last-of-type", "p:nth-last-of-type(2)", "p + p + p", "div > div div > p", "p:nth-last-child(3)", ":not(div div div) p", "div:has(p) p", "div:is(div div) div p"],
)
def test_deep_and_wide_pages_are_quick(selector):
    """Chains of steps take time in proportion to the page, whatever its depth or width."""
    deep = parse("<body>" + "<div>" * 400 + "<div></div>" + "<p>x</p>" * 3000 + "</div>" * 400)
    plan, began = css.parse_css(selector), time.process_time()
    assert len(list(css.results(deep, plan))) > 0
    assert time.process_time() - began < 1.5


CHAINS = st.lists(st.sampled_from(["div", "span", "*", "p", ":first-child", "p:last-of-type", ".k", "span:only-of-type"]), min_size=1, max_size=4)


def _ends_chain(tree, i, parts, links):
    """Whether node i ends the chain, by trying every way back."""
    if i not in css.select_nodes(tree, css.parse_css(parts[-1])):
        return False
    if len(parts) == 1:
        return True
    kids = tree.children[tree.parent[i]] if tree.parent[i] >= 0 else [i]
    before = kids[: kids.index(i)]
    near = {" ": tree.ancestors(i), ">": tree.ancestors(i)[:1], "+": before[-1:], "~": before}[links[-1]]
    return any(_ends_chain(tree, k, parts[:-1], links[:-1]) for k in near)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("dspk/"), max_size=30), CHAINS, st.lists(st.sampled_from(" >+~"), min_size=3, max_size=3))
def test_chains_are_what_trying_all_ways_finds(shape, parts, links):
    html = "".join({"d": "<div>", "s": "<span class=k>", "p": "<p>x</p>", "k": "<div class=k>t", "/": "</div>"}[c] for c in shape)
    tree, links = parse(f"<body>{html}"), links[: len(parts) - 1]
    text = parts[0] + "".join(f" {k} {p}" for k, p in zip(links, parts[1:], strict=True))
    assert css.select_nodes(tree, css.parse_css(text)) == [i for i in range(len(tree)) if _ends_chain(tree, i, parts, links)]


TAGS = st.sampled_from("div span section em table ul article".split())
TEXTS = st.text(st.characters(codec="utf-8", exclude_characters="\x00\r", exclude_categories=["Cs", "Cc"]), min_size=1, max_size=8).filter(lambda s: s.strip())
TREES = st.recursive(st.tuples(TAGS, TEXTS, st.just([])), lambda kids: st.tuples(TAGS, TEXTS, st.lists(kids, max_size=3)), max_leaves=12)


def _html(node):
    from html import escape

    tag, text, kids = node
    return f"<{tag}>{escape(text)}{''.join(map(_html, kids))}</{tag}>"


@settings(max_examples=60, deadline=None)
@given(TREES)
def test_round_trip_and_intervals(tree):
    html = f"<html><body>{_html(tree)}</body></html>"
    t = parse(html)
    assert outer_html(parse(outer_html(t))) == outer_html(t)
    for i in range(len(t)):
        assert i <= t.end[i] < len(t)
        assert t.level[i] == len(t.ancestors(i))
        if t.parent[i] >= 0:
            assert t.parent[i] < i and t.end[i] <= t.end[t.parent[i]]
    for kids in t.children:
        assert all(t.end[a] < b for a, b in zip(kids, kids[1:], strict=False))


@settings(max_examples=150, deadline=None)
@given(st.text("<>/ab p=\"'&;!-", max_size=60))
def test_any_text_parses(s):
    t = parse(s)
    assert t.tag[0] == "html" and t.end[0] == len(t) - 1


@pytest.mark.parametrize(
    "selector, found",
    [
        ("body #board .lines section.line", ["section"] * 4),
        ('#board section.line:not(:contains("Fully booked"))', ["section"] * 3),
        (".fare::text", ["EUR 2.40", "EUR 3.10", "EUR 1.85", "EUR 5.00"]),
        ("aside a::attr(href)", ["/quay", "/mill?zone=2", "/kiln", "/fair"]),
        ("section:nth-child(2n+1) > h4::text", ["Harbour", "Heath"]),
        ("section:nth-last-child(1) h4::text", ["Haven"]),
        ("li:nth-of-type(2) > a::text", ["Mill"]),
        ("li:first-child a::text, li:last-child a::text", ["Quay", "Fair"]),
        ("h4 + em", ["em"] * 4),
        ("h4 ~ i", ["i"] * 4),
        ("section:has(> .seats)", ["section"] * 4),
        ('section[data-no="19"] h4::text', ["Hill"]),
        ('a[href^="/q"], a[href$="=2"], a[href*="air"]', ["a"] * 3),
        ("h1, h1, title", ["title", "h1"]),
        (":root", ["html"]),
        ("u:only-child::text", ["Depot \u00a7 9"]),
        ("fieldset.remark:is([data-stars='5'], .nothing) cite::text", ["Piet"]),
        (".express, [class~=express] > b::text", ["section", "EUR 2.40"]),
        ("section > b:last-of-type + i", ["i"] * 4),
        ("section:nth-last-of-type(2) ~ section h4::text", ["Haven"]),
        ("li + li + li a::text", ["Kiln", "Fair"]),
        ("em:only-of-type", ["em"] * 4),
    ],
)
def test_css(selector, found):
    assert C(selector) == found


@pytest.mark.parametrize(
    "path, found",
    [
        ('//form[@id="remarks"]//fieldset[@data-stars >= 4]', ["fieldset"] * 2),
        ('//section[number(substring-after(.//b[@class="fare"], "EUR ")) > 3]/h4/text()', ["Hill", "Haven"]),
        ("//li[2]/a/@href", ["/mill?zone=2"]),
        ("(//li)[1]/a/text()", ["Quay"]),
        ('//a[contains(translate(text(), "KILN", "kiln"), "kiln")]', ["a"]),
        ("//h4/following-sibling::*[1]", ["em"] * 4),
        ("//*[count(ancestor::*) = 1]", ["head", "body"]),
        ("//section[position() = last()]/@data-no", ["40"]),
        ("//section[1] | //address", ["section", "address"]),
        ('//q[normalize-space(text()) = "Quiet."]/..', ["fieldset"]),
        ('//a[@href="/kiln"]/ancestor::aside', ["aside"]),
        ("//h4[not(contains(., 'rb')) and ../@data-no < 20]/text()", ["Hill"]),
    ],
)
def test_xpath(path, found):
    assert X(path) == found


def test_xpath_variables():
    t = parse(DIARY)
    assert [t.text[i] for i, _ in xpath.results(t, "//td[text()=$cell]", 0, {"cell": "kale 30"})] == ["kale 30"]


@pytest.mark.parametrize("bad", ["7 up", "a[", "", ">", "a >> b", "a::nothing", ":nothing", "a,,b", "a:nth-child(x)"])
def test_bad_css(bad):
    with pytest.raises(css.SelectorSyntaxError):
        css.parse_css(bad)


@pytest.mark.parametrize("bad", ["7 up", "//a[", "", "//a[foo()]", "nothing::a", "//a/", "count(//a)"])
def test_bad_xpath(bad):
    with pytest.raises(css.SelectorSyntaxError):
        xpath.results(T, bad)


def test_filters():
    tags = lambda plan, tree=T: [tree.tag[i] for i, _ in plan.nodes(tree)]
    assert tags(find_all("section", {"class": "line"})) == ["section"] * 3
    assert tags(find_all(["h1", "h4"], lambda t, i: "ea" in (t.text[i] or ""))) == ["h4"]
    assert tags(find_all({"href*": "zone"})) == ["a"]
    assert tags(find_all(class_="fare")) == ["b"] * 4
    import re

    assert tags(find_all(re.compile(r"(peas|beans|kale) \d+")), parse(DIARY)) == ["td"] * 3
    with pytest.raises(TypeError):
        find_all()
    assert len(find_by_text("Seats left:", partial=True, first_match=False).nodes(T)) == 3
    assert len(find_by_text("fully booked", first_match=False).nodes(T)) == 1
    assert find_by_text("fully booked", case_sensitive=True).nodes(T) == []
    assert [T.text[i] for i, _ in find_by_regex(r"Seats left: \d+").nodes(T)] == ["Seats left: 12"]
    assert len(find_by_regex(r"seats left: \d+", first_match=False).nodes(T)) == 3
    assert clean(" a\t\n b  c\r") == "a b c"


def test_text_and_markdown():
    t = parse("<div>a<script>x</script>b<style>y</style>c<p>d</p>e</div>")
    assert t.all_text() == "a\nb\nc\nd\ne"
    assert parse(DIARY).all_text(separator=" | ", strip=True, ignore=("table",)) == "May | Sown | Thinned | Rain | Wind"
    assert markdown(parse("<h1>Title</h1><p>P <b>bold</b> <a href='/u'>l</a></p>")) == "Title\n=====\n\nP **bold** [l](/u)"
    assert markdown(parse("<ol><li>a</li><li>b</li></ol><ul><li>c</li></ul>")) == "1. a\n2. b\n\n* c"
    assert "<li>" in outer_html(parse("<ul><li>x</ul>"), pretty=True)


def test_references_without_a_semicolon_are_text():
    """As titles cut inside a reference have them; a query string's &copy=1 too."""
    t = parse('<title>a &amp; b &amp</title><h1 id="?x&copy=1&amp;y">c&&amp;&copy; &notit; &#38;&#x26 d&am</h1>')
    assert t.text[t.tag.index("title")] == "a & b &amp"
    h1 = t.tag.index("h1")
    assert t.text[h1] == "c&&© &notit; && d&am"
    assert t.attrs(h1) == {"id": "?x&copy=1&y"}
