"""Visibility rules, form controls, list numbers and the table grid of the layout; properties on random pages."""

from __future__ import annotations

import random
import re

from voltlake.llm.html_layout import extract, page_text as page


def test_row_spans_keep_columns():
    assert page("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert page("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>") == "a  b  c\nd     e\nf     g"
    # a span ends with its row group, and two of them leave the columns between them
    assert page("<table><thead><tr><td rowspan=9>h<td>i<tbody><tr><td>x<td>y</table>") == "h  i\nx  y"
    assert page("<table><tr><td rowspan=2>a<td>b<td rowspan=2>c<tr><td>d<tr><td>e<td>f<td>g</table>") == "a  b  c\n   d\ne  f  g"
    assert page("<table><tr><td colspan=2 rowspan=2>ab<td>c<tr><td>d<tr><td>1<td>2<td>3</table>") == "ab     c\n       d\n1   2  3"


def test_wide_spans():
    cells = "<td colspan=5000>a<td>b"
    assert page(f"<table><tr>{cells}<tr>{'<td>x' * 3}</table>") == "a        b\nx  x  x"
    assert page("<table><tr>" + "<td colspan=1000>a" * 300 + "</table>") == "  ".join(["a"] * 300)


def test_visibility():
    assert page('<div style="visibility:hidden">no<b style="visibility:visible">yes</b>no</div>') == "yes"
    assert page('<div style="visibility:hidden">no<b>no</b></div>after') == "after"
    assert page('<div style="display:none"><b style="visibility:visible">no</b></div>x') == "x"
    assert page('<p hidden style="display:block">shown</p>') == "shown"
    assert page('<ul style="visibility:hidden"><li>no<li style="visibility:visible">yes</ul>') == "- yes"
    assert page('<table><tr><td style="display:none">n<td>a<tr><td>b</table>') == "a\nb"
    assert page('<p style="visibility:hidden"><img alt=no><input value=no>x') == ""


def test_style_elements():
    sheet = "<style>/* .k{display:none} */ .h, p#i {display:none} .k{color:red} @media print {.k{display:none}}</style>"
    assert page(f"{sheet}<b class='x h'>no</b><p id=i>no</p><p class=k>yes</p>") == "yes"
    assert page(f"<b class=h>no</b>yes{sheet}") == "yes"
    assert page("<style>p{display:none}.s{display:block}</style><p>no<p class=s>yes") == "yes"
    assert page("<style>.h{display:none}</style><b class=h style='display:inline'>yes</b>") == "yes"
    assert page("<style media=print>.h{display:none}</style><b class=h>yes</b>") == "yes"
    assert page("<style>div .h{display:none} .h:hover{display:none}</style><b class=h>yes</b>") == "yes"
    assert page("<style>.h{display:none") == ""


def test_controls():
    assert page("<input type=checkbox value=on><input type=RADIO value=r><input type=file>ok") == "ok"
    assert page("<input type=password value=secret><input type=password placeholder=Password>") == "Password"
    assert page("<input type=image alt=go value=no><input type=submit value=Send> <input placeholder=Name>") == "goSend Name"
    assert page("<textarea><b>x</b> &amp; y</textarea>z") == "<b>x</b> & y\n\nz"
    assert page("<details><summary>s</summary>no<p>no</details>x") == "s\nx"
    assert page("<details open><summary>s</summary>yes</details>") == "s\nyes"
    assert page("<details>no</details>x") == "x"


def test_list_numbers():
    assert page("<ol><li>a<li value=7>b<li>c</ol>") == "1. a\n7. b\n8. c"
    assert page("<ol reversed><li>a<li>b<li>c</ol>") == "3. a\n2. b\n1. c"
    assert page("<ol reversed start=2><li>a<li value=x>b</ol>") == "2. a\n1. b"


def _random_page(rng: random.Random, words: list[str], depth: int = 0, shown: bool = True) -> tuple[str, list[str]]:
    """A random page and the words of it that show, in order."""
    html, seen = [], []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(("word", "block", "none", "hidden", "visible", "list", "table", "span") if depth < 4 else ("word",))
        if kind == "word":
            words.append(f"w{len(words)}")
            html.append(f" {words[-1]} ")
            seen += [words[-1]] * shown
            continue
        visible = {"hidden": False, "visible": True}.get(kind, shown)
        parts = [_random_page(rng, words, depth + 1, visible) for _ in range(rng.randint(1, 3))]
        inner = "".join(p[0] for p in parts)
        if kind != "none":
            seen += [w for p in parts for w in p[1]]
        html.append({
            "block": f"<div>{inner}</div>", "span": f"<b>{inner}</b>", "none": f"<div class=gone>{inner}</div>",
            "hidden": f"<div style='visibility:hidden'>{inner}</div>", "visible": f"<div style='visibility:visible'>{inner}</div>",
            "list": "<ul>" + "".join(f"<li>{p[0]}</li>" for p in parts) + "</ul>",
            "table": "<table>" + "".join(f"<tr><td>{p[0]}</td></tr>" for p in parts) + "</table>",
        }[kind])
    return "".join(html), seen


def test_each_visible_word_once_and_in_order():
    for seed in range(300):
        html, want = _random_page(random.Random(seed), [])
        got = re.findall(r"w\d+", page(html + "<style>.gone{display:none}</style>"))
        assert got == want, html


def test_columns_are_aligned():
    """Random grids with spans: every cell of one column begins at one place of its line."""
    for seed in range(200):
        rng = random.Random(seed)
        columns, held, html, want = rng.randint(1, 5), {}, [], {}
        for r in range(rng.randint(1, 6)):
            html.append("<tr>")
            c = 0
            while c < columns:
                if held.get(c, 0) > r:
                    c += 1
                    continue
                room = next((k for k in range(c, columns) if held.get(k, 0) > r), columns) - c
                across, down = rng.randint(1, room), rng.randint(1, 3)
                name = f"r{r}c{c}" + "x" * rng.randint(0, 5)
                html.append(f"<td colspan={across} rowspan={down}>{name}</td>")
                held.update(dict.fromkeys(range(c, c + across), r + down))
                want[name] = c
                c += across
            html.append("</tr>")
        lines = page(f"<table>{''.join(html)}</table>").split("\n")
        starts = {}
        for name, c in want.items():
            at = {line.index(name) for line in lines if name in line.split()}
            assert len(at) == 1
            starts.setdefault(c, set()).update(at)
        assert all(len(at) == 1 for at in starts.values()), html


def test_tables_of_pages(spark):
    """Null, empty, long and repeated pages, and a table without pages."""
    long = "<table>" + "<tr><td rowspan=2>a<td>b<tr><td>c" * 20_000 + "</table>"
    rows = [(1, None), (2, ""), (3, long), (4, "<p>x"), (4, "<p>x"), (None, "<b>k</b>")]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 AS text", "'t' AS n_chars")
    got = sorted(map(tuple, extract(pages).collect()), key=str)
    assert [r[1:] for r in got if r[0] != 3] == [("", 0, 0), ("", 0, 0), ("x", 1, 1), ("x", 1, 1), ("k", 1, 1)]
    text = next(r[1] for r in got if r[0] == 3)
    assert text == "\n".join(["a  b", "   c"] * 20_000)
    assert extract(pages.limit(0)).count() == 0
