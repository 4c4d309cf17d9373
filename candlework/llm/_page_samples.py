"""Pages with known content, made by rule, that the block classifier of html_text is fitted on.

LAYOUTS are page skeletons as sites use them: semantic elements, tables, wrappers named after what stands beside them,
page-wide forms, no names at all. ``{A}``, ``{P}`` and ``{H}`` stand for the article, a paragraph and a heading of it; lower-case
letters stand for what isn't content: ``{p}`` prose of something else, ``{m}`` a menu, ``{f}`` a footer line, ``{s}`` a sidebar paragraph, ``{l}`` a list of links to
other articles, ``{n}`` a notice, ``{c}`` reader comments, ``{d}`` an advert, ``{t}`` a byline with tags, ``{i}`` form fields.
"""

from __future__ import annotations

import random

#: Pages that are made of each layout.
TIMES = 12
#: What marks the text of content in a sample.
MARK = "␟"

LAYOUTS = [
    "<html><body><header><h1>{w}</h1>{m}</header><main><article>{A}</article></main><aside>{s}</aside><footer>{f}</footer></body></html>",
    "<html><body><nav>{m}</nav><div class=ad>{d}</div><article>{A}</article><footer>{f}</footer></body></html>",
    "<html><body><div id=header>{m}</div><div id=content>{A}</div><div id=sidebar>{s}{l}</div><div id=footer>{f}</div></body></html>",
    "<html><body><div class='layout with-sidebar'><div class=topbar>{m}</div><div class=post>{A}<div class=share>{l}</div></div><div class=sidebar>{s}</div></div></body></html>",
    "<html><body><form id=aspnetForm><div class=nav>{m}</div><div class=main>{A}</div><div class=login>{i}</div><div>{f}</div></form></body></html>",
    "<html><body><table><tr><td class=menu>{m}</td><td>{A}</td><td>{s}{l}</td></tr><tr><td colspan=3>{f}</td></tr></table></body></html>",
    "<html><body><div>{m}</div><div>{A}</div><div>{l}</div><div>{f}</div></body></html>",
    "<html><body><div class='page no-header'><article>{A}<section id=comments>{c}</section></article><div class=related>{l}</div></div></body></html>",
    "<html><body><div class=wrapper><div class=cookie-banner>{n}</div><div class=masthead>{m}</div><div class='entry-content'>{A}</div><div class=comment-list>{c}</div></div></body></html>",
    "<html><body><div role=navigation>{m}</div><div role=main>{A}<div class=newsletter>{n}{i}</div></div><div role=contentinfo>{f}</div></body></html>",
    "<html><body><div class='article-header'>{H}{t}</div><div class='article-body'>{P}{P}<div class='ad-slot'>{d}</div>{P}</div><div class='article-footer'>{t}{l}</div><footer>{f}</footer></body></html>",
    "<html><body>{m}{A}{f}</body></html>",
    "<html><body><main>{A}<aside class=pullout>{d}</aside>{P}{P}</main><div class=discussion>{c}</div><nav>{l}</nav></body></html>",
    "<html><body><section class=hero><h1>{w}</h1>{n}</section><section>{A}</section><section class=subscribe>{n}{i}</section><section class=links>{l}</section></body></html>",
    "<html><body><div id=page><div id=main><div id=story>{A}{t}</div><div id=rail>{d}{l}</div></div><div id=legal>{f}</div></div></body></html>",
    "<html><body><ul class=breadcrumbs><li><a href=/>{w}</a></li><li><a href=/x>{w}</a></li></ul><article class=hentry>{A}</article><div class='post-navigation'>{l}</div><div id=respond>{i}</div></body></html>",
    "<html><body><dl class=menu><dt><a href=/>{w}</a></dt></dl><blockquote>{A}</blockquote><small>{f}</small></body></html>",
    "<html><body><div>{s}</div><main>{A}</main><div>{n}</div><section>{s}{l}</section></body></html>",
    "<html><body><div>{m}</div><article>{A}</article><div><p>{w} {w}</p>{p}</div><div>{f}</div></body></html>",
    "<html><body><div class=container><div class=row><div class=col>{m}</div><div class=col>{A}</div><div class=col>{s}</div></div><div class=row>{f}</div></div></body></html>",
]

_WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name president team minute idea".split()


def pages() -> list[str]:
    """Pages in which the texts of content begin with MARK; always the same ones."""
    rng = random.Random(20)
    some = lambda n: " ".join(rng.choice(_WORDS) for _ in range(n))
    said = lambda low, high: some(rng.randrange(low, high)).capitalize() + rng.choice(".....!?")
    prose = lambda k: " ".join(said(5, 22) for _ in range(rng.randrange(1, k)))
    links = lambda n, low, high: "<ul>" + "".join(f"<li><a href=/{i}>{some(rng.randrange(low, high))}</a></li>" for i in range(n)) + "</ul>"

    def paragraph() -> str:
        if rng.random() < 0.12:
            return f"<ul>{''.join(f'<li>{MARK}{said(3, 15)}</li>' for _ in range(3))}</ul>"
        if rng.random() < 0.1:
            return f"<p>{MARK}{said(1, 4)}</p>"
        linked = f" <a href=/y>{some(3)}</a> {said(4, 9)}" if rng.random() < 0.2 else ""
        return f"<p>{MARK}{prose(6)}{linked}</p>"

    heading = lambda k=2: f"<h{k}>{MARK}{some(rng.randrange(2, 9))}</h{k}>"
    make = {
        "A": lambda: heading(1) + "".join(paragraph() + (heading(3) if rng.random() < 0.15 else "") for _ in range(rng.randrange(2, 9))),
        "P": paragraph, "H": lambda: heading(1), "p": lambda: paragraph().replace(MARK, ""), "w": lambda: some(2),
        "m": lambda: links(rng.randrange(3, 9), 1, 3), "f": lambda: f"<p>&copy; 20{rng.randrange(10, 30)} {some(2)}. All rights reserved.</p>" + (f"<p><a href=/a>{some(1)}</a> | <a href=/b>{some(2)}</a></p>" if rng.random() < 0.6 else ""),
        "s": lambda: f"<h4>{some(2)}</h4><p>{said(4, 20)}</p>", "l": lambda: f"<h3>{some(2)}</h3>" + links(rng.randrange(2, 7), 4, 11), "n": lambda: f"<p>{said(5, 14)} <a href=/n>{some(2)}</a></p>",
        "c": lambda: "".join(f"<div class=comment><b>{some(1)}</b> {rng.randrange(1, 28)} May<p>{prose(4)}</p><a href=/r>Reply</a></div>" for _ in range(rng.randrange(1, 5))),
        "d": lambda: f"<p>{said(3, 10)}</p>", "t": lambda: f"<p>By {some(2)} | {rng.randrange(1, 28)} May 2020 | <a href=/t>{some(1)}</a> <a href=/u>{some(1)}</a></p>", "i": lambda: f"<label>{some(2)}</label><input><button>{some(1)}</button>",
    }
    out = []
    for layout in LAYOUTS:
        for _ in range(TIMES):
            page, at = [], 0
            while at < len(layout):
                if layout[at] == "{":
                    page.append(make[layout[at + 1]]())
                    at += 3
                else:
                    page.append(layout[at])
                    at += 1
            out.append("".join(page))
    return out
