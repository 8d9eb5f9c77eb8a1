"""Labelled pages for the extraction model, written from a seed.

Each page is a list of (label, html) parts put together by one of many layouts; label 1 is main
text. The layouts vary in what marks the parts: element names, classes and ids, or only place
and wording. They are written without regard to the pages that are extracted later.
"""

from __future__ import annotations

import random

SYLLABLES = "ba co di fe gu la mo ne pi ro su ta ve wi xo zen mar tol kin per".split()
MENU = "Home About Contact Products News Sign-in Archive Support Blog Shop Jobs Search".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def _sentence(r: random.Random, least: int = 4, most: int = 18) -> str:
    words = [_word(r) for _ in range(r.randint(least, most))]
    if r.random() < 0.3:
        words[len(words) // 2] += ","
    return " ".join(words).capitalize() + r.choice("...!?")


def _paragraph(r: random.Random) -> str:
    if r.random() < 0.12:
        return _word(r).capitalize() + "."
    text = " ".join(_sentence(r) for _ in range(r.randint(1, 7)))
    kind = r.random()
    if kind < 0.08:
        text = " ".join(w + r.choice(["***", "###", "%%%", "$$$", "&amp;&amp;"]) for w in text.split())
    elif kind < 0.14:
        text = text.upper()
    elif kind < 0.2:
        text = " | ".join(text.split())
    elif kind < 0.26:
        text = " ".join([text.split()[0]] * r.randint(5, 60))
    elif kind < 0.32:
        text += f" &copy; {_word(r)} 20{r.randint(10, 29)}"
    if r.random() < 0.25:
        text = text.replace(" ", f' <a href="/{_word(r)}">{_word(r)}</a> ', 1)
    if r.random() < 0.15:
        text = f"<b>{text}</b>" if r.random() < 0.6 else f"<b>{text}<br>"
    return text


def _box(r: random.Random, tags: list[str], names: list[str], inside: str) -> str:
    tag = r.choice(tags)
    how = r.random()
    mark = f' class="{r.choice(names)}"' if how < 0.5 else f' id="{r.choice(names)}"' if how < 0.75 else ""
    if tag in ("div", "section", "p", "ul", "span") and not mark:
        mark = f' class="{r.choice(names)}"'
    return f"<{tag}{mark}>{inside}</{tag}>"


def _links(r: random.Random, n: int) -> str:
    names = [r.choice(MENU) if r.random() < 0.5 else _word(r) for _ in range(n)]
    return "<ul>" + "".join(f'<li><a href="/{x}">{x}</a></li>' for x in names) + "</ul>" if r.random() < 0.7 else " | ".join(f'<a href="/{x}">{x}</a>' for x in names)


def _short(r: random.Random) -> str:
    return " ".join(_word(r) for _ in range(r.randint(2, 9))).capitalize() + r.choice([".", "", "!"])


def _head(r: random.Random) -> str:
    """What stands before the shown part; none of it is text."""
    lines = [f"<title>{_short(r)}</title>"]
    if r.random() < 0.6:
        lines.append(r.choice(['<meta charset="utf-8">', f'<meta name="description" content="{_sentence(r)}">']))
    if r.random() < 0.5:
        lines.append(f"<style>.{_word(r)} {{ color: #{r.randrange(1000):03} }}</style>")
    if r.random() < 0.5:
        lines.append(f'<script src="/{_word(r)}.js"></script>' if r.random() < 0.5 else f"<script>if (1 < 2) {{ {_word(r)}(); }}</script>")
    if r.random() < 0.3:
        lines.append(f'<link rel="stylesheet" href="/{_word(r)}.css">')
    r.shuffle(lines)
    return r.choice(["<!doctype html>", "<!DOCTYPE HTML>", ""]) + r.choice(["<html>", f'<html lang="{r.choice(["de", "en", "fr"])}">']) + "<head>" + "".join(lines) + "</head><body>"


def _imprint(r: random.Random) -> str:
    owner = f"{_word(r).capitalize()} {r.choice(['Ltd', 'GmbH', 'Press', 'Media', 'Foundation'])}"
    return r.choice([f"&copy; {2000 + r.randrange(30)} {owner}", f"{owner}. {_short(r)}", f"Copyright {owner}", f"&#169; {owner} - {_short(r)}", _links(r, 3)])


def page(seed: int) -> list[tuple[int, str]]:
    """Parts of a page in order, with labels; joined they are its html."""
    r = random.Random(seed)
    junk: list[tuple[int, str]] = []
    before = [
        _box(r, ["nav", "div", "ul"], ["menu", "nav", "navbar", "top-nav", "navigation"], _links(r, r.randint(3, 9))),
        _box(r, ["header", "div"], ["header", "site-header", "masthead", "banner"], r.choice([f"<h2>{_short(r)}</h2>", f"<p>{_short(r)}</p>", _links(r, 3)])),
        _box(r, ["div", "section"], ["cookie", "cookie-notice", "notice", "consent", "alert"], f"<p>{_sentence(r)}</p><button>{_word(r)}</button>"),
        _box(r, ["div", "aside", "ins"], ["ad", "ads", "advert", "promo", "sponsored", "banner-ad"], r.choice([_short(r), f"<p>{_sentence(r)}</p>"])),
        _box(r, ["div", "ul", "ol"], ["breadcrumb", "breadcrumbs", "crumbs"], _links(r, 3)),
    ]
    after = [
        _box(r, ["footer", "div"], ["footer", "site-footer", "copyright", "legal"], _imprint(r)),
        _box(r, ["aside", "div"], ["sidebar", "side", "related", "widget", "rail"], f"<h3>{_short(r)}</h3>" + _links(r, r.randint(2, 6))),
        _box(r, ["section", "div", "ol"], ["comments", "comment-list", "responses", "discussion"], "".join(f'<div class="comment"><b>{_word(r)}</b><p>{_paragraph(r)}</p></div>' for _ in range(r.randint(1, 4)))),
        _box(r, ["form", "div"], ["search", "subscribe", "newsletter", "login", "form"], f"<label>{_short(r)}</label><input name=q><button>{_word(r)}</button>"),
        _box(r, ["div", "section"], ["share", "social", "tags", "meta"], _links(r, 4)),
    ]
    r.shuffle(before)
    r.shuffle(after)
    junk += [(0, x) for x in before[: r.randint(1, 4)]]
    head = _head(r)
    body: list[tuple[int, str]] = []
    title = _short(r)
    if r.random() < 0.85:
        body.append((1, f"<h1>{title}</h1>"))
    for _ in range(r.randint(1, 14)):
        kind = r.random()
        if kind < 0.8:
            body.append((1, f"<p>{_paragraph(r)}</p>" if r.random() < 0.85 else f"<p>{_paragraph(r)}"))
        elif kind < 0.87:
            body.append((1, f"<h2>{_short(r)}</h2>"))
        elif kind < 0.92:
            body.append((1, "<ul>" + "".join(f"<li>{_sentence(r)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"))
        elif kind < 0.95:
            body.append((1, f"<blockquote>{_sentence(r)}</blockquote>"))
        elif kind < 0.97:
            body.append((1, f"<pre>{_sentence(r)}</pre>"))
        else:
            body.append((0, _box(r, ["div", "aside"], ["ad", "promo", "related", "newsletter"], _short(r))))
    wrap = r.choice(["article", "article", "article", "main", "div class=content", "div id=content", "div class=post-body", "section class=article", ""])
    opening, closing = (f"<{wrap}>", f"</{wrap.split()[0]}>") if wrap else ("", "")
    tail = [(0, x) for x in after[: r.randint(1, 4)]]
    if r.random() < 0.3:
        junk.append((0, "<!-- comment -->"))
    return [(0, head), *junk, (0, opening), *body, (0, closing), *tail, (0, "</body></html>" if r.random() < 0.9 else "")]
