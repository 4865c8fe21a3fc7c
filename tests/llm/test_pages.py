"""Blocks of pages, the recurrent labeller and main texts."""

from __future__ import annotations

import numpy as np
import pytest

from spanloom.llm import html_main_text
from spanloom.llm.html_blocks import BiLSTM, blocks, page_matrix


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks_of_awkward_markup():
    assert texts(None) == [] and texts("") == [] and texts("plain &amp; text") == ["plain & text"]
    assert texts("<p>a<br>b<p>c <b>d</b>e&nbsp;f<!-- x <p>y --></p>") == ["a b", "c de f"]
    assert texts('<script>var t="</p><p>x";</script><p>ok</p><style>p{}</style>') == ["ok"]
    assert texts("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>") == ["one", "two", "in", "three"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("<p>cut <b>off") == ["cut off"] and texts("<p>a</div>b</p>") == ["a", "b"]
    assert texts("a < b and c<p>d</p>") == ["a < b and c", "d"]
    assert texts("<head><title>t</title><body>x") == ["x"]
    assert [b.path for b in blocks('<div class="Side-Bar x"><p id=main>t</p></div>')] == [("div", "side", "bar", "x", "p", "main")]
    assert blocks("<p>ab <a href=x>link</a></p>")[0].linked == 4


@pytest.mark.parametrize("tag", "video audio object svg math select canvas iframe datalist".split())
def test_elements_that_are_never_closed_hide_nothing(tag):
    assert texts(f"<article><p>one</p><{tag} src=a><p>two</p><p>three</p></article>") == ["one", "two", "three"]
    assert texts(f"<p>a</p><{tag} src=a><p>b</p><{tag}>x</{tag}><p>c</p>")[:2] == ["a", "b"]


def test_closed_silent_elements_are_skipped_whole():
    assert texts("<p>a <video><p>no video</p></video>b<svg><text>s</text></svg></p><select><option>o</select><p>c") == ["a b", "c"]
    assert texts("<p>E is <math><mi>mc</mi></math>.") == ["E is mc."]
    assert texts("<p>a</p><script>var x = '<p>'") == ["a"]


def test_broken_pages_take_time_and_memory_in_proportion():
    import time
    import tracemalloc

    pages = {
        "quotes": '<a title="x ' * 90_000, "mixed": "<p>t<a title='x <b title=\"y " * 40_000, "inline": "<p>a" + "<font class=x>" * 100_000 + "b</p><p>c",
        "items": "<font>" * 50_000 + "<li>x" * 50_000, "ends": "<b><i>" * 50_000 + "x" + "</b>" * 50_000, "hidden": "<p>x<video>" * 50_000 + "</video>",
    }
    for name, page in pages.items():
        tracemalloc.start()
        began = time.perf_counter()
        found = blocks(page)
        assert time.perf_counter() - began < 20, name
        assert tracemalloc.get_traced_memory()[1] < 200e6, name
        tracemalloc.stop()
        if name == "inline":
            assert [b.text for b in found] == ["ab", "c"]
        if name == "items":
            assert len(found) == 50_000
    assert texts('<p>before</p><a title="never closed>link</a><p>after</p>') == ["before", "link", "after"]


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = BiLSTM(hidden=3)
    xs = [rng.standard_normal((n, net.p["wi"].shape[0])).astype(np.float32) * 0.3 for n in (4, 2)]
    x, mask = net.padded(xs)
    y = mask * (rng.random(mask.shape) > 0.5)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    _, grad = net.gradients(x.astype(np.float64), mask.astype(np.float64), y)
    for name in ("wo", "whf", "whb", "bf", "wi"):
        at = tuple(0 for _ in net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = net.gradients(x, mask, y)[0]
        net.p[name][at] = old - 1e-2
        down = net.gradients(x, mask, y)[0]
        net.p[name][at] = old
        assert abs((up - down) / 2e-2 - grad[name][at]) < 2e-3


@pytest.fixture(scope="module")
def labeller():
    return html_main_text.train([], made=700)


def test_made_pages_that_were_not_seen(labeller):
    rng = np.random.default_rng(77)
    pool = [" ".join("".join(rng.choice(list("etaoinsrhl"), 5)) for _ in range(60)) + "." for _ in range(100)]
    right = total = 0
    for _ in range(150):
        page = blocks(html_main_text.made_page(rng, pool))
        want = np.array([b.text.startswith(html_main_text._MAIN) for b in page])
        for b in page:
            b.text = b.text.lstrip(html_main_text._MAIN) or "-"
        got = labeller.predict(page_matrix([page]))[0] >= 0.5
        right, total = right + (got == want).sum(), total + len(want)
    assert right / total > 0.97


def test_extraction_of_a_table(spark, labeller):
    prose = "This is a sentence of the text, and it goes on for a while. " * 3
    page = f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class=ad>Buy this thing now.</div><article><h1>A &lt;title&gt;</h1><p>{prose}<p>{prose}</article><footer>&copy; someone</footer></body></html>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (None, "w", page), (4, "x", "<nav><a href=/>a</a></nav>"), (5, "y", page.replace("<p>", "<p>" + prose * 2000, 1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars", "'z' as c0")
    got = sorted(((str(r.page_id), r.text, r.n_chars) for r in html_main_text.extract(df, labeller).collect()), key=lambda r: (r[0], r[2]))
    want = "A <title>\n" + "\n".join([prose.strip()] * 2)
    assert [r for r in got if r[0] in "1 None"] == [("1", want, len(want)), ("1", want, len(want)), ("None", want, len(want))]
    assert [r[1:] for r in got if r[0] in "23"] == [("", 0), ("", 0)] and next(r[1] for r in got if r[0] == "4") == ""
    assert next(r[2] for r in got if r[0] == "5") > 300_000
    assert html_main_text.extract(df.limit(0), labeller).count() == 0
