"""Wrappers of known templates; no text is lost; folding and alignment against direct expansion."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strideway.llm import wrappers as w

PAGE = '<html><head><title>{t}</title></head><body><nav><a href="/">Home</a></nav><h1>{t}</h1>{extra}<ul>{items}</ul><p>All rights reserved</p></body></html>'


def page(t, items, extra=""):
    return PAGE.format(t=t, items="".join(f"<li>{i}</li>" for i in items), extra=extra)


def test_wrapper_of_a_template():
    pages = [page("one", "abc"), page("two", "xy", "<div class='note'>hi</div>"), page("three", "k")]
    skeletons = [w.shown(w.fold(w.tokens(p)[0])[0]) for p in pages]
    wrapper, slots = w.infer(skeletons)
    assert "(<div.note>#</div>)?" in wrapper.replace(")?(", "") or "<div.note>" in wrapper
    assert "(<li>#</li>)+" in wrapper
    for s, own in zip(skeletons, slots):
        assert len(own) == w.slots_of(w.parsed(s))


def test_extraction(spark):
    rows = [(1, "http://h/1", page("one", "abc")), (2, "http://h/2", page("two", "xy", "<div class='note'>hi</div>")),
        (3, "http://h/3", page("three", "kk"))]
    out = {r.page_id: r for r in w.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out[1].text == "one\na\nb\nc" and out[2].text == "two\nhi\nx\ny" and out[3].text == "three\nk\nk"


@pytest.mark.parametrize("around", ["form", "aside", "header", "div class=share"])
def test_content_inside_chrome_names(spark, around):
    """An element of a chrome name that encloses the page is none; one beside the content is."""
    wrap = lambda t: f"<html><{around}>{t}</{around.split()[0]}></html>"
    rows = [(1, "http://h/1", wrap("<h1>a title</h1><p>the first body of some length</p><nav>home</nav>")),
        (2, "http://h/2", wrap("<h1>other</h1><p>a second body of some length</p><nav>home</nav>")),
        (3, "http://g/1", "<p>body text that is long enough</p>" + f"<{around}>beside</{around.split()[0]}>")]
    out = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out == {1: "a title\nthe first body of some length", 2: "other\na second body of some length",
        3: "body text that is long enough"}


def brute_content(pages):
    """Texts by page outside nav that are not the same at their place in all pages, for pages of one list-free layout."""
    texts = [re.findall(r">([^<]+)<", re.sub(r"<nav>.*?</nav>", "", p)) for p in pages]
    fixed = [len({t[k] for t in texts}) == 1 for k in range(len(texts[0]))]
    return ["\n".join(x for x, f in zip(t, fixed) if not f) for t in texts]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c"]), min_size=3, max_size=3), min_size=2, max_size=4))
def test_extraction_against_brute_force(spark, rows):
    pages = [f"<html><nav>menu</nav><h1>{x}</h1><div>{y}</div><p>{z}</p><i>same</i></html>" for x, y, z in rows]
    if len(set(pages)) < 2:
        return
    df = spark.createDataFrame([(k, "http://h/", p) for k, p in enumerate(pages)], "page_id bigint, url string, html string")
    assert [r.text for r in w.extract(df).orderBy("page_id").collect()] == brute_content(pages)


def test_long_pages_fold_quickly():
    import time

    began = time.perf_counter()
    w.fold([f"<t{i}>" if i % 2 else "#" for i in range(200_000)])
    assert time.perf_counter() - began < 20


def expanded(nodes, times=2):
    return [x for n in nodes for x in (expanded(n.body, times) * times if isinstance(n, w.Group) else [n])]


tags = st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "#", "<li>", "</li>", "<ul>", "</ul>"]), max_size=40)


@settings(max_examples=200, deadline=None)
@given(tags)
def test_folding_keeps_every_text(symbols):
    nodes, held = w.fold(symbols)
    assert sorted(i for h in held for own in h for i in own) == [i for i, s in enumerate(symbols) if s == "#"]
    assert [len(h) for h in held] == [w.slots_of([n]) for n in nodes]
    assert w.parsed(w.shown(nodes)) == nodes


def pattern(wrapper: str) -> re.Pattern:
    return re.compile(re.sub(r"<[^>]*>|~?#", lambda m: f"(?:{re.escape(m.group())})", wrapper).replace("(", "(?:").replace("(?:?:", "(?:"))


@settings(max_examples=100, deadline=None)
@given(st.lists(tags, min_size=1, max_size=4))
def test_the_wrapper_accepts_every_page(pages):
    skeletons = list(dict.fromkeys(w.shown(w.fold(p)[0]) for p in pages))
    wrapper, slots = w.infer(skeletons)
    for s, own in zip(skeletons, slots):
        nodes = w.parsed(s)
        assert len(own) == w.slots_of(nodes)
        assert pattern(wrapper).fullmatch("".join(expanded(nodes, 1)))
        assert pattern(wrapper).fullmatch("".join(expanded(nodes, 2)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.booleans())
def test_common_places(a, b, halved):
    import numpy as np

    cells, w.CELLS = w.CELLS, 4 if halved else w.CELLS
    try:
        got = w.common_places(np.array(a, np.int64), np.array(b, np.int64))
    finally:
        w.CELLS = cells
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_no_content_is_lost(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    out = {r.page_id: r for r in w.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)
        if body and out[r.page_id].n_slots:
            texts = [t for s, t in zip(*_texts(body.group(1)))]
            assert all(t in out[r.page_id].text for t in texts if len(t) > 40)


def _texts(part):
    symbols, texts = w.tokens(part)
    return [s for s in symbols if s.endswith("#")], texts


@pytest.mark.parametrize("url,host", [("http://A.b:80/x", "a.b"), ("https://u@c.d?q", "c.d"), (None, ""), ("nothing", "")])
def test_hosts(url, host):
    assert w.host_of(url) == host
