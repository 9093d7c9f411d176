"""Labelled pages for training the block classifier: layouts drawn by rule from a seed, each block labelled main or not.

A page has site parts (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) around an article that
may sit in different elements; parts occur outside and inside the article's element. Every block's text is unique on its
page by construction, so a label is found by the text.
"""

from __future__ import annotations

import html
import random

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo an er in on ul es tion ment heit keit ción eau".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def _sentence(r: random.Random, low: int, high: int, end: str = ".") -> str:
    words = [_word(r) for _ in range(r.randint(low, high))]
    if r.random() < 0.15:
        words = [w + r.choice(("%%%", "***", "###", "&&&", "$$$")) for w in words]
    words[0] = words[0].capitalize()
    return " ".join(words) + end


def _text(r: random.Random) -> str:
    return " ".join(_sentence(r, 2, 18) for _ in range(r.choice((1, 1, 2, 4, 8))))


def _links(r: random.Random, n: int) -> list[str]:
    return [f'<a href="/{_word(r)}">{_word(r).capitalize()}</a>' for _ in range(n)]


def _menu(r):
    items = _links(r, r.randint(3, 8))
    body = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.8 else " | ".join(items)
    tag, name = r.choice((("nav", ""), ("div", "menu"), ("ul", "nav"), ("div", "breadcrumb"), ("nav", "main-nav"), ("div", "navigation")))
    return f"<{tag}{_class(r, name)}>{body}</{tag}>"


def _class(r, name):
    return "" if not name else f' {r.choice(("class", "class", "id"))}="{name}"'


def _header(r):
    tag, name = r.choice((("header", ""), ("div", "header"), ("header", "site-header"), ("div", "masthead"), ("div", "top-bar")))
    return f"<{tag}{_class(r, name)}>{r.choice(('<h1>%s</h1>', '<a href=\"/\">%s</a>', '<p>%s</p>', '<h2>%s</h2>')) % _sentence(r, 1, 5, '')}{'<p>' + _sentence(r, 3, 8) + '</p>' if r.random() < 0.4 else ''}</{tag}>"


def _footer(r):
    tag, name = r.choice((("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright"), ("div", "legal")))
    inner = f"{r.choice(('&copy; ', 'Copyright ', ''))}{_word(r)}.example.com &middot; {_sentence(r, 2, 12)}"
    return f"<{tag}{_class(r, name)}>{r.choice(('%s', '<p>%s</p>')) % inner}</{tag}>"


def _side(r):
    tag, name = r.choice((("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "related"), ("section", "related-posts"), ("div", "widget"), ("div", "share"), ("div", "tags"), ("div", "recommended"), ("div", "author-bio")))
    body = "".join(r.choice(("<h3>%s</h3>", "<p>%s</p>", "<li>%s</li>")) % _sentence(r, 2, 20, r.choice((".", ""))) for _ in range(r.randint(1, 4)))
    return f"<{tag}{_class(r, name)}>{body}</{tag}>"


def _notice(r):
    name = r.choice(("cookie", "cookie-banner", "cookies", "consent", "gdpr", "notice", "alert", "banner", "modal", "popup", "overlay", "paywall", "newsletter", "subscribe"))
    tag = r.choice(("div", "div", "section", "p"))
    return f"<{tag}{_class(r, name)}>{_sentence(r, 4, 25)}{'' if tag == 'p' else '<button>' + _word(r) + '</button>'}</{tag}>"


def _advert(r):
    name = r.choice(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "promotion", "sponsor"))
    tag = r.choice(("div", "div", "aside", "section", "p"))
    return f"<{tag}{_class(r, name)}>{'<p>' if tag != 'p' and r.random() < 0.5 else ''}{_sentence(r, 3, 20)}</{tag}>"


def _form(r):
    return f"<form{_class(r, r.choice(('', 'search', 'login', 'contact', 'signup')))}><label>{_sentence(r, 1, 3, '')}</label><input name=q><select><option>{_word(r)}</option></select><textarea>{_word(r)}</textarea><button>{_word(r)}</button><p>{_sentence(r, 3, 10)}</p></form>"


def _comments(r):
    tag, name = r.choice((("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "discussion"), ("div", "replies"), ("section", "responses"), ("div", "user-comments")))
    item = r.choice(("<p>%s</p>", "<div class=\"comment\"><p>%s</p></div>", "<li>%s</li>", "<article class=\"comment\"><p>%s</p></article>", "<blockquote>%s</blockquote>"))
    return f"<{tag}{_class(r, name)}><h3>{_sentence(r, 1, 3, '')}</h3>{''.join(item % _text(r) for _ in range(r.randint(1, 4)))}</{tag}>"


PARTS = (_side, _notice, _advert, _form, _comments, _menu)


def page(seed: int) -> tuple[str, set[str]]:
    """HTML and the texts of its main blocks."""
    r = random.Random(seed)
    main: set[str] = set()

    def keep(text: str) -> str:
        main.add(text)
        return html.escape(text, quote=False)

    out = []
    title = _sentence(r, 2, 9, r.choice(("", ".")))
    body = [f"<h1>{keep(title)}</h1>"]
    for _ in range(r.choice((0, 1, 2, 4, 8, 12))):
        kind = r.random()
        if kind < 0.72:
            body.append(f"<p>{keep(_text(r))}</p>")
        elif kind < 0.80:
            body.append(f"<h2>{keep(_sentence(r, 1, 6, ''))}</h2>")
        elif kind < 0.86:
            body.append("<ul>" + "".join(f"<li>{keep(_sentence(r, 1, 12))}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
        elif kind < 0.91:
            body.append(f"<blockquote>{keep(_text(r))}</blockquote>")
        elif kind < 0.95:
            body.append("<table>" + "".join(f"<tr><td>{keep(_sentence(r, 1, 5, ''))}</td></tr>" for _ in range(2)) + "</table>")
        else:
            text = _sentence(r, 4, 12)
            first, rest = text.split(" ", 1)
            main.add(text)
            body.append(f'<p><a href="/x">{html.escape(first, quote=False)}</a> {html.escape(rest, quote=False)}</p>')
    for _ in range(r.choice((0, 0, 1, 2))):
        body.insert(r.randint(1, len(body)), r.choice(PARTS)(r))
    tag, name = r.choice((("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "entry-content"), ("section", "story"), ("div", "post-content")))
    article = f"<{tag}{_class(r, name)}>{''.join(body)}</{tag}>"
    if r.random() < 0.3:
        article = f"<main>{article}</main>" if tag != "main" else article
    if r.random() < 0.25:
        article = f'<div class="{r.choice(("container", "wrapper", "page", "row"))}">{article}</div>'
    top = [p(r) for p in (_header, _menu, _notice, _advert) if r.random() < 0.5]
    end = [p(r) for p in (_comments, _side, _form, _advert, _notice, _footer) if r.random() < 0.5]
    r.shuffle(top)
    out = [f"<!DOCTYPE html><html><head><title>{html.escape(title)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>", *top, article, *end, "</body></html>"]
    return "".join(out), main


def pages(n: int, seed: int = 1) -> list[tuple[str, set[str]]]:
    return [page(seed * 1_000_003 + i) for i in range(n)]
