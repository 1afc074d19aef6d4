"""Page text: odd markup, time in proportion to the page, and what browsers show."""

from __future__ import annotations

import random
import time

import pytest

from packlens.llm.q_render import op8_html_text
from packlens.llm.render import render, rendered

SHOWN = {
    # Labels, formulas, drawings.
    "<input type=submit value=Go> <input type=reset> <input value=typed> <button>B</button>": "Go Reset B",
    "<select><optgroup label=Fruit><option>fig<option>pear</select>": "Fruit\nfig\npear",
    "<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>": "x=2",
    "a <svg><title>no</title><defs><text>no</text></defs><text>yes</text>no<text>too</text></svg> b": "a yes too b",
    # Visibility.
    "<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>": "b",
    "<div style='display:none'>a<b style='visibility:visible'>b</b></div>c": "c",
    "<details><summary>S</summary>hidden<p>hidden</details><details open><summary>T</summary>seen</details>": "S\nT\nseen",
    "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
    # Lists and tables.
    "<ol><li>a<li value=7>b<li>c</ol>": "1. a\n7. b\n8. c",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<table><tr><td>aa<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>": "aa  b  c\nd      e\nf      g",
    "<table><tbody><tr><td rowspan=9>a<td>b</tbody><tbody><tr><td>c<td>d</table>": "a  b\nc  d",
    "<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>": "ab     c\nd   e  f",
    # Markup that is none.
    "a<b": "a", "a <": "a <", "a</": "a</", "x <!-- never": "x", "x <p title='never>y": "x", "1<2 and 3>2": "1<2 and 3>2", "<a b\"c>d</a>": "d",
    "<table><caption><colgroup><table><option>o": "o",
}


@pytest.mark.parametrize("page", SHOWN)
def test_shown(page):
    assert render(page) == SHOWN[page]


def test_any_sequence_of_tokens_gives_a_text():
    rng = random.Random(7)
    names = "table caption colgroup col tr td th tbody thead tfoot option select optgroup p li ul ol div b svg math text title textarea script style details summary dialog form template html head body br hr img input frameset".split()
    odd = ["<", ">", "</", "<!--", "-->", "<!", "<?", "\"", "'", "=", "&amp;", "&", "text ", "\n", " ", "<a href='", "/>", "\0"]
    for _ in range(50_000):
        parts = []
        for _ in range(rng.randint(1, 12)):
            name, kind = rng.choice(names), rng.random()
            parts.append(f"<{name}>" if kind < 0.5 else f"</{name}>" if kind < 0.65 else f"<{name} rowspan=2 colspan={rng.randint(0, 3)} hidden/>"[: rng.choice([30, 99])] if kind < 0.75 else rng.choice(odd))
        assert isinstance(render("".join(parts)), str)


@pytest.mark.parametrize("part", ["<a ", "<a b='", "<a \"", "<table>", "<table><a>x", "<script>", "<script></script ", "</b", "<!-", "<p", "<td rowspan=3>", "&", "<li>", "<svg>", "</table>", "<a b=\"\" "])
def test_time_grows_with_the_page(part):
    def spent(n):
        start = time.process_time()
        render(part * n)
        return time.process_time() - start

    spent(100)
    small, large = spent(4_000), spent(32_000)
    assert large < 0.05 or large < 24 * small, (small, large)


def test_empty_tables_and_repeated_rows(spark, small):
    pages = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "x"), (None, None, "y"), (2, "", "z")], "page_id long, html string, text string")
    got = pages.select("page_id", rendered(pages["html"]).alias("t")).collect()
    assert sorted(map(str, (r["t"] for r in got))) == ["", "None", "a", "a"]
    assert pages.limit(0).select(rendered(pages["html"])).collect() == []
    assert op8_html_text(spark, small).filter("text is null").count() == spark.read.parquet(f"{small}/pages.parquet").filter("html is null").count()
