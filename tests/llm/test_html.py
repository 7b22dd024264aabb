"""Visible text against random trees whose words are known, and pages that break the rules."""

from __future__ import annotations

import random
import time

import pytest

from heliogable.llm.html import text_of

#: What hides, what shows again inside it: (attributes, displayed, visible or None where inherited).
LOOKS = (
    ("", True, None), ("", True, None), ("", True, None), (" class=gone", False, None), (" id=off", False, None), (" style='display:none'", False, None), (" hidden", False, None), (" style='visibility:hidden'", True, False),
    (" style='VISIBILITY: visible'", True, True), (" class='gone back'", True, None), (" style='display:none;display:inline-block'", True, None), (" title=it's", True, None), (" class=paper", True, None), (" data-x='a>b'", True, None),
)
SHEET = "<style>/* .none{display:none} */ .gone{display:none} #off{display:none} .gone.back{display:block} @media print{.paper,p,div{display:none}} @media (max-width:700px){li{display:none}} @font-face{src:url(x)}</style>"


class Tree:
    """A random page with the words that show in it, and the lines that blocks put them on."""

    def __init__(self, seed: int):
        self.r, self.words, self.lines, self.n = random.Random(seed), [], [[]], 0
        self.html = SHEET + self.block(0, True, True) + self.block(0, True, True)

    def word(self, shown: bool, seen: bool) -> str:
        self.n += 1
        if shown and seen:
            self.lines[-1].append(f"w{self.n}")
        return f" w{self.n} "

    def look(self, shown: bool, seen: bool) -> tuple[str, bool, bool]:
        text, display, visible = self.r.choice(LOOKS)
        return text, shown and display, seen if visible is None else visible

    def inline(self, depth: int, shown: bool, seen: bool) -> str:
        out = []
        for _ in range(self.r.randint(1, 3)):
            if depth > 4 or self.r.random() < 0.6:
                out.append(self.word(shown, seen))
            else:
                tag = self.r.choice(("b", "span", "a", "em"))
                text, s, v = self.look(shown, seen)
                if "back" in text or "inline-block" in text:  # these would make a block of it
                    text, s, v = "", shown, seen
                out.append(f"<{tag}{text}>{self.inline(depth + 1, s, v)}</{tag}>")
        return self.r.choice(("", "<!-- c --!>", "<!-->")).join(out)

    def block(self, depth: int, shown: bool, seen: bool) -> str:
        kind = self.r.choice(("p", "div", "ul", "section", "script") if depth < 4 else ("p",))
        text, s, v = self.look(shown, seen)
        self.lines.append([])
        if kind == "script":
            return f"<script>var a = '<p>no{self.n}</p>';</script>"
        if kind == "p":
            out = f"<p{text}>{self.inline(depth, s, v)}" + self.r.choice(("</p>", "") if depth == 0 else ("</p>",))
            self.lines.append([])
            return out
        parts = []
        for _ in range(self.r.randint(1, 3)):
            if kind == "ul":
                own, s2, v2 = self.look(s, v)
                self.lines.append([])
                parts.append(f"<li{own}>{self.inline(depth, s2, v2)}" + self.r.choice(("</li>", "")))
            else:
                parts.append(self.block(depth + 1, s, v))
        self.lines.append([])
        return f"<{kind}{text}>{''.join(parts)}</{kind}>"


@pytest.mark.parametrize("seed", range(150))
def test_random_trees(seed):
    page = Tree(seed)
    got = [[w for w in line.split() if w != "-"] for line in text_of(page.html).split("\n")]
    assert [line for line in got if line] == [line for line in page.lines if line], page.html


def test_grid():
    """Cells of a random table stand in their columns."""
    r = random.Random(1)
    cells = [[f"c{i}{j}" * r.randint(1, 30 if j == 1 else 3) for j in range(4)] for i in range(6)]
    lines = text_of("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in cells) + "</table>").split("\n")
    starts = [0]
    for j in range(3):
        starts.append(starts[-1] + max(len(row[j]) for row in cells) + 2)
    assert len(lines) == 6 and all(line[s:].startswith(c) for line, row in zip(lines, cells, strict=True) for s, c in zip(starts, row, strict=True))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p don't>hello world</p><p>it's next</p><p>last</p>", "hello world\n\nit's next\n\nlast"),
        ("<a href=x'y>link</a> text <b>it's</b> end", "link text it's end"),
        ('<a href="x"">text</a> more', "text more"),
        ("x <!-- a --!> y", "x y"),
        ("a<!-->b", "ab"),
        ("a<!--->b", "ab"),
        ("<p>a</ p>b</>c</p>", "abc"),
        ("<div style='visibility:hidden'>a<span style='visibility:visible'>b</span>c</div>", "b"),
        ("<style>@media print{.nav{display:none}}</style><div class=nav>nav</div>", "nav"),
        ("<style>@media screen{.nav{display:none}}</style><div class=nav>nav</div>x", "x"),
        ("<style>@media screen and (min-width:900px){.a{display:none}.b{color:red}}.b{visibility:hidden}</style><p class=a>a<p class=b>b<p>c", "c"),
        ("<style>.a{display:none}.a{display:block}</style><p class=a>yes", "yes"),
        ("<style>.a{display:none!important}</style><p class=a style='display:block'>no", ""),
        ("<style>#x{display:block}.a{display:none}</style><p class=a id=x>yes", "yes"),
        ("<style>.nav ul{display:none}.nav > li{display:none}</style><div class=nav><ul><li>a</ul></div><ul><li>b</ul>", "- b"),
        ("<style>a[rel=ad]{display:none}a:hover{display:none}p + p{display:none}</style><a rel=ad>x</a><a>y</a><p>1<p>2", "y\n\n1\n\n2"),
        ("<svg><title>t</title><text>drawn</text><desc>d</desc></svg> <math><mi>x</mi><annotation>tex</annotation></math> <map><a>area</a></map>", "drawn x area"),
        ("<b><p>x</b>y</p>z", "xy\n\nz"),
        ("<table><tr><td>日本<td>b<tr><td>abcdef<td>c</table>", "日本    b\nabcdef  c"),
        ("<ol><li>a<li style='visibility:hidden'>b<li>c</ol>", "1. a\n3. c"),
        ("<dialog>no</dialog><dialog open>yes</dialog><details><summary>s</summary>no</details>", "yes\ns"),
    ],
)
def test_pages(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize("page", ["<ul><li>" * 50_000, "<p><object>" + "<div>" * 50_000, "<b>" * 50_000 + "<p>" * 50_000, "<p>" * 50_000 + "</p>" * 50_000, "<a " * 50_000, "<!--" * 50_000, "<a '" * 50_000, "<table><tr><td>" * 1_500])
def test_deep_pages(page):
    began = time.time()
    text_of(page + "</p>x")
    assert time.time() - began < 15
