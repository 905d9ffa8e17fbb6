"""Labelled pages to learn the extraction model from: layouts put together at random, every part labelled by construction."""

from __future__ import annotations

import random

from tallyloom.llm.html import Model, train

MARKER = "data-content"
_SYLLABLES = "ka lo mi ten sar vo el na pri da qu et ur fo stan be ri go lim pa".split()


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


def _sentences(r: random.Random, n: int) -> str:
    return " ".join(_words(r, r.randint(3, 18)).capitalize() + r.choice([".", ".", ", " + _words(r, 4) + ".", "?"]) for _ in range(n))


def _links(r: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{i}">{_words(r, r.randint(1, 3))}</a></li>' for i in range(n)) + "</ul>"


def _named(r: random.Random, tag: str, *names: str) -> str:
    return f'{tag} {r.choice(["class", "class", "id"])}="{r.choice(names)}"'


def _no(open_: str, inside: str) -> str:
    return f'<{open_} {MARKER}="0">{inside}</{open_.split()[0]}>'


def _article(r: random.Random) -> str:
    parts = [f"<h1>{_words(r, r.randint(2, 9))}</h1>"] if r.random() < 0.9 else []
    if r.random() < 0.2:
        parts = [f"<header>{''.join(parts)}</header>"]
    for _ in range(r.randint(1, 9)):
        kind = r.random()
        if kind < 0.7:
            text = _sentences(r, r.choice([1, 1, 2, 4, 7]))
            parts.append(f"<p>{text}</p>" if r.random() < 0.8 else f"<p><b>{text}<br><p>{_sentences(r, 2)}</p>")
        elif kind < 0.78:
            parts.append(f"<h2>{_words(r, 4)}</h2>")
        elif kind < 0.85:
            parts.append("<ul>" + "".join(f"<li>{_sentences(r, 1)}</li>" for _ in range(3)) + "</ul>")
        elif kind < 0.9:
            parts.append(f"<blockquote><p>{_sentences(r, 2)}</p></blockquote>")
        elif kind < 0.94:
            parts.append("<table>" + "".join(f"<tr><td>{_words(r, 2)}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(3)) + "</table>")
        elif kind < 0.955:
            parts.append(f'<figure><img src="x.png"><figcaption>{_sentences(r, 1)}</figcaption></figure>' if r.random() < 0.6 else "<dl>" + "".join(f"<dt>{_words(r, 2)}</dt><dd>{_sentences(r, 1)}</dd>" for _ in range(3)) + "</dl>")
        elif kind < 0.965:
            parts.append(f"<pre><code>{_words(r, 12)}</code></pre>" if r.random() < 0.5 else f"<section><h3>{_words(r, 3)}</h3><p>{_sentences(r, 2)}</p></section>")
        elif kind < 0.98:
            parts.append(_no(_named(r, "div", "ad", "advert", "promo", "sponsored"), _sentences(r, 1)))
        else:
            parts.append(_no(_named(r, "div", "share", "social-share", "related", "newsletter-signup"), _links(r, 3)))
    shell = r.choice(["article", "article", "article", "main", _named(r, "div", "content", "post-body", "entry-content", "article-text", "story"), "section"])
    return f'<{shell} {MARKER}="1">{"".join(parts)}</{shell.split()[0]}>'


def _comment(r: random.Random) -> str:
    return f'<div class="{r.choice(["comment", "comment-body", "reply", "post-comment"])}"><b>{_words(r, 1)}</b><p>{_sentences(r, r.randint(1, 4))}</p></div>'


def labelled_page(r: random.Random) -> str:
    before, after = [], []
    some = lambda p: r.random() < p
    if some(0.5):
        before.append(_no(r.choice(["header", _named(r, "div", "header", "masthead", "topbar")]), _words(r, 3) + (_links(r, 3) if some(0.5) else "")))
    if some(0.8):
        before.append(_no(r.choice(["nav", "nav", _named(r, "div", "menu", "navbar", "nav-main", "breadcrumbs")]), _links(r, r.randint(3, 9))))
    if some(0.5):
        before.append("<!-- ad -->" + _no(_named(r, "div", "ad", "ads", "ad-slot", "advertisement", "sponsor"), _sentences(r, r.randint(1, 2))))
    if some(0.4):
        before.append(_no(_named(r, "div", "cookie", "cookie-notice", "consent", "alert", "popup"), _sentences(r, r.randint(1, 3)) + ("<button>ok</button>" if some(0.5) else "")))
    if some(0.4):
        (before if some(0.4) else after).append(_no(r.choice(["aside", _named(r, "div", "sidebar", "widget", "related", "popular")]), f"<h3>{_words(r, 2)}</h3>" + (_links(r, 5) if some(0.6) else f"<p>{_sentences(r, 2)}</p>")))
    if some(0.45):
        after.append(_no(r.choice([_named(r, "section", "comments", "comment-list"), _named(r, "div", "comments", "disqus", "discussion", "replies"), _named(r, "ol", "commentlist")]), "".join(_comment(r) for _ in range(r.randint(1, 5)))))
    if some(0.4):
        (before if some(0.3) else after).append(_no(r.choice(["form", _named(r, "form", "search", "subscribe", "login")]), f"<label>{_words(r, 2)}</label><input><p>{_sentences(r, 1)}</p>"))
    if some(0.85):
        after.append(_no(r.choice(["footer", "footer", _named(r, "div", "footer", "copyright")]), f"&copy; {_words(r, 2)} &middot; {_sentences(r, 1)}"))
    article = _article(r)
    if some(0.12):  # pages laid out by a table, and pages of bare blocks without telling names
        cells = [f'<td valign="top">{"".join(before)}</td>', f"<td>{article}</td>"]
        body = f'<table width="100%"><tr>{"".join(cells)}</tr></table>' + "".join(after)
    elif some(0.12):
        body = "".join(f"<div>{x}</div>" for x in before) + f"<div><div>{article}</div></div>" + "".join(f"<div>{x}</div>" for x in after)
    else:
        body = "".join(before) + article + "".join(after)
    if some(0.4):
        body = f'<div class="{r.choice(["page", "wrapper", "container", "site"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


_MODEL: list[Model] = []


def default_model(pages: int = 600, seed: int = 11) -> Model:
    """The model learned from `pages` labelled pages, always the same ones; learned once for each driver process."""
    if not _MODEL:
        r = random.Random(seed)
        _MODEL.append(train([labelled_page(r) for _ in range(pages)], MARKER))
    return _MODEL[0]
