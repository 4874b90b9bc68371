"""Labelled web pages for training the extraction model: (html, node labels follow from ``data-main``).

The pages are made by a rule from parts: page frames, article bodies and boilerplate parts, each with the
element names, classes and ids that sites commonly use. ``data-main="1"`` opens main text, ``"0"`` opens
boilerplate; elements inherit the mark of the element around them.
"""

from __future__ import annotations

import random
import re

CONTENT = ['<article data-main="1">{}</article>', '<main data-main="1">{}</main>',
           '<article class="post hentry" data-main="1">{}</article>', '<div class="article-body" data-main="1">{}</div>',
           '<div id="content" data-main="1">{}</div>', '<div class="entry-content" data-main="1">{}</div>',
           '<section class="story text" data-main="1">{}</section>', '<div class="post-content" data-main="1">{}</div>',
           '<div itemprop="articleBody" data-main="1">{}</div>', '<main id="main"><article data-main="1">{}</article></main>',
           '<div class="container"><div class="row"><div class="col" data-main="1">{}</div></div></div>',
           '<main role="main"><div class="page-content" data-main="1">{}</div></main>', '<div><div data-main="1">{}</div></div>',
           '<div class="main-content" data-main="1">{}</div>', '<div class="post" data-main="1">{}</div>', '<div id="main" data-main="1">{}</div>',
           '<div role="main" data-main="1">{}</div>', '<main id="content" class="content-area" data-main="1">{}</main>', '<section data-main="1">{}</section>',
           '<div class="article" data-main="1">{}</div>', '<div data-main="1">{}</div>', '<table><tr><td class="content" data-main="1">{}</td></tr></table>',
           '<main><article data-main="1">{}</article></main>', '<article role="article" data-main="1">{}</article>']

#: Elements that open main text where a page has no element around all of it.
OPENERS = re.compile(r"<(p|div|h[1-6]|ul|table|blockquote|figure|pre|header|dl|section|details)\b")

LINKS = ['<nav>{}</nav>', '<nav class="navbar main-menu">{}</nav>', '<ul class="menu nav">{}</ul>', '<div id="menu">{}</div>',
         '<div class="breadcrumb breadcrumbs">{}</div>', '<aside class="sidebar">{}</aside>', '<div id="sidebar" class="widget">{}</div>',
         '<div class="related related-posts">{}</div>', '<div class="recommended more-stories">{}</div>', '<div class="tags tag-cloud">{}</div>',
         '<div class="pagination pager">{}</div>', '<div class="share social sharing">{}</div>', '<div role="navigation" class="toolbar">{}</div>',
         '<section class="popular trending">{}</section>', '<div class="topbar"><ul>{}</ul></div>',
         '<div id="nav" class="navigation">{}</div>', '<div class="links">{}</div>', '<nav aria-label="x"><div>{}</div></nav>',
         '<menu>{}</menu>', '<td class="nav left">{}</td>', '<div class="column"><div class="sidebar">{}</div></div>']

NOTES = ['<div class="ad">{}</div>', '<div class="ads advert advertisement">{}</div>', '<aside>{}</aside>', '<div class="sponsored promo">{}</div>',
         '<div id="banner" class="banner">{}</div>', '<div class="cookie-notice">{}</div>', '<div id="cookie-consent" class="gdpr popup">{}</div>',
         '<div class="notice alert">{}</div>', '<div role="alert" class="notification">{}</div>', '<div class="newsletter subscribe signup">{}</div>',
         '<footer>{}</footer>', '<footer>{}</footer>', '<footer>{}</footer>', '<footer class="site-footer">{}</footer>', '<div id="footer" class="footer copyright">{}</div>',
         '<header>{}</header>', '<header class="site-header masthead">{}</header>', '<div id="header" class="header logo">{}</div>',
         '<div role="banner">{}</div>', '<div role="contentinfo" class="legal disclaimer">{}</div>', '<div class="modal overlay paywall">{}</div>',
         '<div class="sidebar widget">{}</div>', '<aside class="sidebar complementary">{}</aside>', '<div role="complementary">{}</div>',
         '<div hidden>{}</div>', '<div style="display:none">{}</div>',
         '<div class="cookie-banner consent">{}</div>', '<div class="advert">{}</div>', '<div class="advertisement">{}</div>',
         '<div class="promo">{}</div>', '<div class="popup">{}</div>', '<div class="notice">{}</div>', '<aside class="widget">{}</aside>', '<div class="ad-slot">{}</div>', '<div class="banner-ad">{}</div>', '<p class="notice">{}</p>',
         '<aside class="ad">{}</aside>', '<section class="newsletter">{}</section>', '<div class="author-box">{}</div>', '<dialog>{}</dialog>']

FORMS = ['<form>{}</form>', '<form class="search" role="search">{}</form>', '<form id="login" class="login">{}</form>',
         '<form class="contact"><fieldset>{}</fieldset></form>', '<div class="search-form">{}</div>', '<form method="post">{}</form>']

CONTROLS = ['<button>{}</button>', '<select><option>{}</option></select>', '<label>{}</label>', '<button class="btn">{}</button>', '<textarea>{}</textarea>']

COMMENTS = ['<section id="comments">{}</section>', '<div class="comments comment-list">{}</div>', '<ol class="commentlist">{}</ol>',
            '<div id="disqus_thread" class="discussion">{}</div>', '<section class="responses reader-comments">{}</section>',
            '<div class="reviews replies">{}</div>', '<div id="comments">{}</div>', '<section class="comments">{}</section>', '<div class="comment-section">{}</div>']

SYLLABLES = "an er in on the ti re st en ha no si ro la mu ke va do pi ge lo sa".split()


class _Writer:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def word(self) -> str:
        return "".join(self.random.choices(SYLLABLES, k=self.random.randint(1, 4)))

    def sentence(self, low: int = 3, high: int = 14) -> str:
        words = [self.word() for _ in range(self.random.randint(low, high))]
        mark = self.random.choice(["", "", ",", " |", "%%%", " &amp;"])
        return (" ".join(w + (mark if self.random.random() < 0.2 else "") for w in words)).capitalize() + "."

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.random.randint(low, high)))

    def anchor(self) -> str:
        return f'<a href="/{self.word()}">{self.sentence(1, 4)[:-1]}</a>'

    def links(self) -> str:
        items = [self.anchor() for _ in range(self.random.randint(2, 8))]
        return self.random.choice(["<ul>{}</ul>", "{}", "<h3>More</h3><ul>{}</ul>"]).format("".join(f"<li>{a}</li>" for a in items)) \
            if self.random.random() < 0.8 else " ".join(items)

    def part(self) -> str:
        r = self.random
        return r.choice([
            lambda: f"<h1>{self.sentence(2, 9)}</h1>", lambda: f"<h2>{self.sentence(2, 7)}</h2>", lambda: f"<p>{self.prose()}</p>",
            lambda: f"<p>{self.prose()}</p>", lambda: f"<p>{self.prose()}</p>", lambda: f"<p><b>{self.prose(1, 2)}<br><p>{self.prose()}</p>",
            lambda: f"<p>{self.sentence()} {self.anchor()} {self.prose(1, 3)}</p>", lambda: f"<p>{self.sentence(1, 2)}</p>",
            lambda: "<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(3)) + "</ul>", lambda: f"<blockquote><p>{self.prose()}</p></blockquote>",
            lambda: f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>", lambda: f"<pre>{self.sentence()}</pre>",
            lambda: "<table><tr>" + "".join(f"<td>{self.word()}</td>" for _ in range(4)) + "</tr></table>", lambda: f"<div>{self.prose()}</div>",
            lambda: f"<dl><dt>{self.sentence(1, 3)}</dt><dd>{self.prose(1, 2)}</dd></dl>", lambda: f"<p><a href=x>{self.prose(1, 2)}</a></p>",
            lambda: f"<details><summary>{self.sentence(1, 4)}</summary><p>{self.prose(1, 2)}</p></details>", lambda: f"<h4>{self.sentence(1, 5)}</h4><p>{self.prose()}</p>",
            lambda: f"<section><h2>{self.sentence(1, 5)}</h2><p>{self.prose()}</p><p>{self.prose()}</p></section>", lambda: f"<div><p>{self.prose()}</p></div>",
            lambda: f"<p><span>{self.prose(1, 2)}</span> <code>{self.word()}</code> <i>{self.sentence()}</i></p>", lambda: f"<p>{self.word()} {self.word()}.</p>",
            lambda: f"<header><h1>{self.sentence(2, 8)}</h1></header><p>{self.prose()}</p>", lambda: f"<p><em>{self.word()}</em> {self.prose()}</p>",
            lambda: f'<div class="section"><h3>{self.sentence(1, 5)}</h3><p>{self.prose()}</p></div>'])()

    def boilerplate(self) -> str:
        kind = self.random.choice([LINKS, NOTES, NOTES, FORMS, CONTROLS, COMMENTS])
        if kind is LINKS:
            inner = self.links()
        elif kind is FORMS:
            inner = f'<label>{self.sentence(1, 3)}</label><input name=q><button>{self.sentence(1, 2)}</button><p>{self.sentence(2, 6)}</p>'
        elif kind is CONTROLS:
            inner = self.sentence(1, 3)
        elif kind is COMMENTS:
            inner = self.random.choice(["", f"<h2>{self.sentence(1, 3)}</h2>"]) + "".join(
                self.random.choice(['<div class="comment"><p>{}</p></div>', "<p>{}</p>", "<div>{}</div>", '<article class="comment">{}</article>', "<li><p>{}</p></li>", '<div class="comment-body"><span class="author">x</span><p>{}</p></div>'])
                .format(self.prose(1, 6)) for _ in range(self.random.randint(1, 4)))
        else:
            inner = self.random.choice(["{}", "<p>{}</p>", "{} <a href=x>more</a>", "<div><p>{}</p></div>", "&copy; {}", "<h1>{}</h1>", "<h1>{}</h1>", '<a href="/">{}</a>', "<h1>{}</h1><p>{}</p>", "<h3>{}</h3><p>{}</p>", "<p>{}</p><p>{}</p>", "<ul><li>{}</li></ul>", "{} <button>x</button>"]).format(
                self.sentence(1, 2) if self.random.random() < 0.25 else self.prose(1, 2), self.prose(1, 4))
        shell = self.random.choice(kind)
        return shell.replace(">", ' data-main="0">', 1).format(inner)

    def page(self) -> str:
        r = self.random
        parts = [self.part() for _ in range(r.randint(2, 12))]
        if r.random() < 0.8:
            parts.insert(0, f"<h1>{self.sentence(2, 9)}</h1>")
        shell = r.choice(CONTENT) if r.random() < 0.88 else None
        if not shell:
            parts = [OPENERS.sub(r'<\1 data-main="1"', p) for p in parts]
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            parts.insert(r.randint(0, len(parts)), self.boilerplate())
        if r.random() < 0.15:
            parts.append(f'<footer data-main="0">{self.prose(1, 2)}</footer>')
        before = [self.boilerplate() for _ in range(r.randint(0, 4))]
        after = [self.boilerplate() for _ in range(r.randint(0, 4))]
        if r.random() < 0.35:
            name = r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "{}"]).format(self.sentence(1, 4))
            before.insert(0, r.choice(['<header data-main="0">{}</header>', '<header class="site-header" data-main="0">{}</header>', '<div class="header" data-main="0">{}</div>'])
                          .format(name + r.choice(["", f"<p>{self.sentence(1, 8)}</p>", f"<nav>{self.links()}</nav>"])))
        body = "".join([*before, shell.format("".join(parts)) if shell else "".join(parts), *after])
        if r.random() < 0.3:
            body = r.choice(['<div id="wrapper">{}</div>', '<div class="page container">{}</div>', "<div><div>{}</div></div>"]).format(body)
        if r.random() < 0.1:
            return body
        return f"<!DOCTYPE html><html><head><title>{self.sentence(2, 5)}</title></head><body>{body}</body></html>"


def pages(count: int = 1000, seed: int = 11) -> list[str]:
    writer = _Writer(seed)
    return [writer.page() for _ in range(count)]
