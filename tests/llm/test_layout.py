import re
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tarnbeck.llm import layout

CASES = {
    "<p>One <b>two</b>&amp;three<p>Four<br>five": "One two&three\n\nFour\nfive",
    "<title>no</title><script>var a='</p>';</script><style>p{}</style>yes<!-- no --><template>no</template>": "yes",
    "<ul><li>a<li>b<ol start=3><li>c<li value=7>d</ol></ul>": "- a\n- b\n  3. c\n  7. d",
    "<table><tr><th>Name<th>Qty<tr><td>apple<td>10</table>": "Name   Qty\napple  10",
    "<table><tr><td rowspan=2>x<td>y<tr><td>zz</table>": "x  y\n   zz",
    "<table><caption>Cap</caption>loose<tr><td colspan=2>wide cell<tr><td>a<td>b</table>": "Cap\nloose\nwide cell\na  b",
    "<div hidden>no</div><div style='display: none'>no</div><p style='visibility:hidden'>no</p><i>yes</i>": "yes",
    "<style>.z, #q {display:none}</style><p class='a z'>no</p><p id=q>no</p><p class=a>yes</p>": "yes",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>u</details>": "s\nt\nu",
    "<pre>\n a\n\n  b\n</pre>": " a\n\n  b",
    "a<hr>b": "a\n\n---\n\nb",
    "<blockquote>q<p>r</blockquote>s": "> q\n\n> r\n\ns",
    "<dl><dt>t<dd>d</dl>": "t\n    d",
    "a < b & c &lt;d&gt; <3": "a < b & c <d> <3",
    "<h1>A<h2>B</h2>c": "A\n\nB\n\nc",
    "<p>x</p></p>y": "x\n\ny",
    "<select><option>a<option>b</select>": "a\nb",
    "<textarea>\n<b>raw</b></textarea>": "<b>raw</b>",
    "<p>a<table><tr><td>b<p>c</table>d": "a\n\nb\n\nc\n\nd",
    "a b  c\n d": "a b c d",
    "<b>x<p>y</b>z": "x\n\nyz",
    "<p>unclosed <a href=\"x": "unclosed",
    "<p style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no": "yes",
    "<style>.v {visibility:hidden} b {visibility:visible}</style><p class=v>no<b>yes</b>": "yes",
    "<form><input name=q value=words> <input type=submit value=Go><input type=hidden value=no><input placeholder=hint></form>": "words Gohint",
    "<table><tr><td>ab<br>c<td>d<tr><td>x<td>y</table>": "ab  d\nc\nx   y",
    "<table><tr><td>a<td>b<tr><td>" + "long " * 20 + "<td>c<tr><td>dd<td>e</table>": "a   b\n" + ("long " * 20).strip() + "\nc\ndd  e",
    "<div>" * 300 + "<p hidden>secret</p>ok": "ok",
    "<div>" * 300 + "<table><tr><td>a<td>b<tr><td>cc<td>dd</table>": "a   b\ncc  dd",
    "<blockquote>" * 5000 + "q": "> " * 32 + "q",
    "<table><tr><td>x" * 300: "\n\n".join(["x"] * 300),
    "": "",
}


@pytest.mark.parametrize("html", CASES)
def test_rendering(html):
    assert layout.render(html) == CASES[html]


TAGS = st.sampled_from("p div b i ul ol li table tr td th h1 h2 span a blockquote pre br hr dl dt dd section caption select option".split())
PIECES = st.one_of(TAGS.map("<{}>".format), TAGS.map("</{}>".format), st.text(alphabet="abc<>&\"'=/! -\n", max_size=6), st.integers(0, 999).map(" w{} ".format))


@given(st.lists(PIECES, max_size=40))
def test_no_visible_word_is_lost(pieces):
    html = "".join(pieces)
    shown = re.findall(r"w\d+", layout.render(html))
    outside = re.sub(r"<!--.*?(?:-->|\Z)|<[!/a-zA-Z?].*?(?:>|\Z)", " ", html, flags=re.S) if not re.search(r"[\"'!]|<[/?]?[^a-zA-Z/]", html) else ""
    assert sorted(re.findall(r"w\d+", outside)) == sorted(shown) or not outside


@given(st.text())
def test_any_text_renders(text):
    assert isinstance(layout.render(text), str)


@pytest.mark.parametrize("part", ["<div>", "<p>x", "<b><p>x", "<table><tr><td>", "<a href=\"", "<!--", "<li>", "</p>", "&", "<", "<td", "<script>", "<ul><li>x", "<table><tr><td>x", "<ol><li>x", "<div hidden>", "<blockquote>x"])
def test_time_is_linear(part):
    began = time.perf_counter()
    layout.render(part * 20_000)
    assert time.perf_counter() - began < 5


def test_table_of_pages(spark):
    rows = [(1, "<p>a", "t"), (1, "<p>a", "t"), (2, None, "t"), (3, "", "t"), (None, "b", "t"), (4, "<p>" + "x " * 200_000, "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(((r.page_id or 0, r.text if r.text is None else r.text[:3]) for r in layout.extract_text(df).collect()), key=str)
    assert got == [(0, "b"), (1, "a"), (1, "a"), (2, None), (3, ""), (4, "x x")]
    assert layout.extract_text(df.limit(0)).count() == 0
