"""Labelled pages to train on: made from seeded layouts, with every leaf block's label known.

The layouts mix semantic tags, generic boxes with telling class names and old
table layouts; they place menus, headers, footers, sidebars, notices, adverts,
forms, captions of widgets and reader comments around or inside an article.
"""

from __future__ import annotations

import random

_SYLLABLES = "the an in re ti on er st en th and ea or is it to be of ha wh sch ung ver ein keit ción ado mente que los tre eau ment aux ier ção ri va lo mi na".split()
_MENU = "Home|News|About us|Contact|Products|Blog|Archive|Login|Sign up|Search|Help|FAQ|World|Sport|Politics".split("|")
_FOOT = "© 2021 {w}. All rights reserved.|Copyright {w} 2019|Privacy policy · Terms of use · Imprint|Powered by {w}|© {w} · Contact us|{w}.example.com · {w} {w} {w}".split("|")
_NOTICE = "We use cookies to improve your experience. Accept all|This site uses cookies. By continuing you agree to our policy.|Please enable JavaScript to view this page.|Subscribe to our newsletter|You have 3 free articles left this month. Subscribe now|Warning: this page is archived.".split("|")
_ADVERT = "Advertisement|Sponsored content|Buy now and save 50%|Sale ends today! Click here|Ad: {w} {w} {w}|Best {w} deals, order online".split("|")
_FORM = "Your email address|Search this site|Enter your name|Submit|Leave a reply|Your comment|Password|Sign in to continue|Send message".split("|")
_COMMENT = "Posted by {w} on May 3, 2018|{w} says:|Reply|Report this comment|Thanks, great post!|I do not agree with {w} at all, {w} {w} {w}.|3 comments".split("|")
_SIDE = "Related articles|Most read|You may also like|Share on social media|Tags: {w}, {w}|Read more|Recent posts|Follow us|Trending now".split("|")


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.labels: list[int] = []

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3))))

    def words(self, lo: int, hi: int) -> str:
        text = " ".join(self.word() + ("," if self.r.random() < 0.08 else "") for _ in range(self.r.randint(lo, hi)))
        return text[:1].upper() + text[1:]

    def prose(self, lo: int = 4, hi: int = 120) -> str:
        text = " ".join(self.words(1, 18).rstrip(",") + "." for _ in range(self.r.randint(1, max(1, self.r.randint(lo, hi) // 10))))
        if self.r.random() < 0.2:
            cut = len(text) // 2
            text = text[:cut] + self.r.choice(("<b>{}</b>", "<a href='/x'>{}</a>", "<em>{}</em>", "<br>{}")).format(text[cut:])
        return ("<b>" + text) if self.r.random() < 0.1 else text

    def fill(self, phrase: str) -> str:
        while "{w}" in phrase:
            phrase = phrase.replace("{w}", self.word(), 1)
        return phrase

    def block(self, tag: str, text: str, label: int, close: bool = True) -> str:
        self.labels.append(label)
        return f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if close else "")

    def box(self, tags: str, inner: str) -> str:
        tag = self.r.choice(tags.split("|"))
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def menu(self) -> str:
        items = "".join(self.block("li", f'<a href="/{self.word()}">{self.r.choice(_MENU) if self.r.random() < 0.5 else self.words(1, 2)}</a>', 0) for _ in range(self.r.randint(2, 9)))
        return self.box('nav|nav|div class="menu"|div id="navigation"|div class="navbar"|div class="nav main-nav"|ul class="breadcrumb"', f"<ul>{items}</ul>")

    def bits(self, tags: str, phrases: list[str], lo: int, hi: int, prose: float = 0.3, inner: str = "p|div|span|li|h3") -> str:
        out = ""
        for _ in range(self.r.randint(lo, hi)):
            text = self.prose(4, 40) if self.r.random() < prose else self.fill(self.r.choice(phrases))
            tag = self.r.choice(inner.split("|"))
            out += self.block("div" if tag == "span" else tag, text, 0)
        return self.box(tags, out)

    def advert(self) -> str:
        text = self.words(4, 20) + "." if self.r.random() < 0.6 else self.fill(self.r.choice(_ADVERT))
        return self.block(self.r.choice(('div class="ad"', 'div class="advert"', 'div id="banner-ad"', 'aside class="sponsor"', 'div class="promo"')), text, 0)

    def article(self) -> str:
        r, out = self.r, ""
        if r.random() < 0.9:
            out += self.block(r.choice(("h1", "h1", "h2", 'h1 class="title"')), self.words(3, 16), 1)
        for _ in range(r.choice((1, 2, 3, 5, 8, 12))):
            kind = r.random()
            if kind < 0.8:
                out += self.block("p", self.prose(), 1, close=r.random() < 0.85)
            elif kind < 0.86:
                out += self.block(r.choice(("h2", "h3")), self.words(2, 8), 1)
            elif kind < 0.9:
                out += "<ul>" + "".join(self.block("li", self.words(2, 14), 1) for _ in range(r.randint(2, 5))) + "</ul>"
            elif kind < 0.93:
                out += "<blockquote>" + self.block("p", self.prose(), 1) + "</blockquote>"
            elif kind < 0.95:
                out += self.block("pre", self.words(3, 20), 1)
            elif kind < 0.97:
                out += self.advert()
            else:
                out += self.bits('div class="share"|aside class="related"|div class="newsletter"|div class="social"', _SIDE, 1, 3)
        return self.box('article|article|article|main|div class="content"|div id="article-body"|section class="post"|div class="entry-content"|td class="main"', out)

    def page(self) -> tuple[str, list[int]]:
        r, self.labels = self.r, []
        order = ["menu"] * (r.random() < 0.9) + ["head"] * (r.random() < 0.5) + ["notice"] * (r.random() < 0.4) + ["advert"] * (r.random() < 0.7)
        r.shuffle(order)
        after = ["comments"] * (r.random() < 0.4) + ["side"] * (r.random() < 0.5) + ["form"] * (r.random() < 0.3) + ["advert"] * (r.random() < 0.3) + ["menu"] * (r.random() < 0.15)
        r.shuffle(after)
        order += ["side"] * (r.random() < 0.2) + ["article"] + after + ["foot"] * (r.random() < 0.9) + ["notice"] * (r.random() < 0.1)
        make = {
            "menu": self.menu, "advert": self.advert, "article": self.article,
            "head": lambda: self.bits('header|header|div class="header"|div id="masthead"', _MENU + ["{w} {w}", "The {w} Times"], 1, 3, 0.1),
            "notice": lambda: self.bits('div class="cookie-notice"|div class="notice"|div id="consent" role="dialog"|div class="alert"|section class="paywall"', _NOTICE, 1, 2, 0.2),
            "comments": lambda: self.bits('section class="comments"|div id="comments"|div class="comment-list"|ol class="commentlist"', _COMMENT, 2, 8, 0.5),
            "side": lambda: self.bits('aside|aside class="sidebar"|div class="sidebar"|div class="related"|div class="widget"', _SIDE, 2, 6, 0.3),
            "form": lambda: self.bits('form|form class="search"|form id="signup"|div class="login-form"', _FORM, 1, 4, 0.1, "label|div|p|button".replace("label", "div")),
            "foot": lambda: self.bits('footer|footer|footer|div class="footer"|div id="bottom"', _FOOT, 1, 3, 0.25),
        }
        body = "".join(make[k]() for k in order)
        if r.random() < 0.3:
            body = f'<div class="{r.choice(("wrapper", "container", "page", "site"))}">{body}</div>'
        return f"<html><head><title>{self.word()}</title><style>p{{}}</style><script>var x='</p>';</script></head><body>{body}</body></html>", self.labels


def labelled_pages(n: int, seed: int = 17) -> list[tuple[str, list[int]]]:
    """n pages with a label for each leaf block: 1 main text, 0 anything else."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
