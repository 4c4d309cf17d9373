"""Main texts of unlike page layouts, none of which the classifier was fitted on, held against texts marked by hand."""

import random
import time

import pytest

from candlework.llm import _page_samples, html_text

A = "The council voted on Tuesday to close the old bridge for repairs that may last until spring."
B = "Traffic will be led over the northern road, which has been widened for the purpose."
C = "Residents were told that buses would run every ten minutes while the work goes on."
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul>'
MORE = '<ul><li><a href="/1">Seven things to know about the harbour</a></li><li><a href="/2">Why the tram was late again</a></li></ul>'
FOOT = "<p>&copy; 2024 The Daily. All rights reserved. <a href=/terms>Terms</a></p>"

# (page, text)
PAGES = {
    "wrapper named after the sidebar it has": (f'<body><div class="layout with-sidebar"><div class="sidebar">{MORE}</div><p>{A}</p><p>{B}</p><p>{C}</p></div></body>', f"{A} {B} {C}"),
    "form around the whole page": (f'<body><form id="aspnetForm" action="x"><div id="nav">{MENU}</div><p>{A}</p><p>{B}</p><p>{C}</p><div class="footer">{FOOT}</div></form></body>', f"{A} {B} {C}"),
    "article in a page without a header": (f'<body><div class="page no-header"><article><h1>Bridge to close</h1><p>{A}</p><p>{B}</p></article></div></body>', f"Bridge to close {A} {B}"),
    "table layout": (f'<body><table><tr><td class="menu">{MENU}</td><td><h1>Bridge to close</h1><p>{A}</p><p>{B}</p><p>{C}</p></td></tr><tr><td class="foot">{FOOT}</td></tr></table></body>', f"Bridge to close {A} {B} {C}"),
    "no names at all": (f"<body><div>{MENU}</div><div><h1>Bridge to close</h1><p>{A}</p><p>{B}</p></div><div>{MORE}</div></body>", f"Bridge to close {A} {B}"),
    "roles": (f'<body><div role="banner">{MENU}</div><div role="main"><p>{A}</p><p>{B}</p></div><div role="complementary"><p>Popular today: the harbour.</p></div><div role="contentinfo">{FOOT}</div></body>', f"{A} {B}"),
    "article with its own header, comments and advert": (
        f'<body><article><header><h1>Bridge to close</h1></header><p>{A}</p><div class="advert"><p>Buy two boats, get one.</p></div><p>{B}</p><section class="comments"><p>I think that this is the worst idea they had this year.</p></section></article></body>',
        f"Bridge to close {A} {B}",
    ),
    "short paragraphs between long ones": (f'<body><nav>{MENU}</nav><main><p>{A}</p><p>Not so.</p><p>{B}</p><p>Yes.</p><p>{C}</p></main><footer>{FOOT}</footer></body>', f"{A} Not so. {B} Yes. {C}"),
    "camel case names and a cookie bar": (f'<body><div id="cookieConsent"><p>We use cookies to make this site better for you.</p></div><div class="articleBody"><p>{A}</p><p>{B}</p></div><div class="relatedLinks">{MORE}</div></body>', f"{A} {B}"),
    "lists and a quote as content": (f"<body><header>{MENU}</header><main><h1>Bridge to close</h1><p>{A}</p><ul><li>It opened in 1931 and was repaired twice since.</li><li>It carries nine thousand cars a day.</li></ul><blockquote>{C}</blockquote></main><aside>{MORE}</aside></body>", f"Bridge to close {A} It opened in 1931 and was repaired twice since. It carries nine thousand cars a day. {C}"),
    "hidden text, references, scripts": (f'<body><main><p>{A}</p><p style="display: none">Not to be seen by anyone who reads this page.</p><script>var a = "<p>no</p>";</script><p>Tea &amp; cake&nbsp;for\n  all those who came &#233; stayed.</p></main></body>', f"{A} Tea & cake for all those who came é stayed."),
    "a script without blanks": ("<body><div><a href=/>首页</a> <a href=/n>新闻</a></div><div><h1>旧桥将关闭</h1><p>市议会星期二投票决定关闭旧桥进行维修，工程可能持续到春天。</p><p>车辆将改走北路，该路已为此拓宽，公共汽车每十分钟一班。</p></div><div><a href=/t>条款</a></div></body>", "旧桥将关闭 市议会星期二投票决定关闭旧桥进行维修，工程可能持续到春天。 车辆将改走北路，该路已为此拓宽，公共汽车每十分钟一班。"),
    "unclosed elements": (f"<body><nav>{MENU}</nav><article><p><b>{A}<p>{B}<br>{C}</article><footer>{FOOT}", f"{A} {B} {C}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    page, text = PAGES[name]
    assert html_text.main_text(page) == text


def test_the_cut_changes_labels_for_the_better():
    sign = cut = changed = 0
    for page in _page_samples.pages():
        found, nodes = html_text.parsed(page)
        odds = html_text.log_odds(found, nodes)
        kept = html_text.min_cut(odds, html_text.smoothness(found))
        truth = [b.text.startswith(_page_samples.MARK) for b in found]
        sign += sum((s > 0) != t for s, t in zip(odds, truth))
        cut += sum(k != t for k, t in zip(kept, truth))
        changed += sum((s > 0) != k for s, k in zip(odds, kept))
    assert changed > 50 and cut < 0.8 * sign


def test_broken_pages_take_linear_time():
    for bad in ('<p a="', "</b></i>", "<div>", "<b><p>", "<a b='\"", "<p>x", "<", "<!--", "</", '<p a=">'):
        began = time.time()
        html_text.main_text(bad * 40_000 + "x")
        assert time.time() - began < 3, bad


def test_any_bytes_are_read():
    rng = random.Random(2)
    for _ in range(300):
        page = "".join(rng.choice(["<", ">", "/", "p", "div", " ", "a", "=", '"', "'", "<p>", "</p>", "<table>", "<td>", "<li>", "</ul>", "<!--", "-->", "&amp;", "x y", "<script>", "</script>"]) for _ in range(60))
        assert html_text.main_text(page) is not None
