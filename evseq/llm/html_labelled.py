"""Labelled pages to train and to test HTML extraction on: composed at random, from a seed, of layouts and parts as sites have them, with
and without telling names. `[+` and `+]` surround the article."""

from __future__ import annotations

import random

SYLLABLES = "ba be bo da de di fa fe ga go ha he ka ki la le lo ma me mi na ne no pa pe ra re ri sa se so ta te ti to va ve wa wi za ze".split()


class Page:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.choice((1, 1, 2, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(4, 18).capitalize() + self.rng.choice("...!?") for _ in range(self.rng.randint(low, high)))

    def name(self, *names: str) -> str:
        """A telling class or id, one that says nothing, or none."""
        x = self.rng.random()
        if x < 0.55:
            return f' {self.rng.choice(("class", "id"))}="{self.rng.choice(names)}"'
        return f' class="{self.rng.choice(("c1", "box2", "inner", "wrap", "block-7"))}"' if x < 0.75 else ""

    def links(self, low: int, high: int, sep: str) -> str:
        return sep.join(f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.rng.randint(low, high)))

    def menu(self) -> str:
        k = self.rng.randrange(5)
        if k == 0:
            return f"<nav><ul><li>{self.links(3, 9, '</li><li>')}</li></ul></nav>"
        if k == 1:
            return f"<div{self.name('menu', 'navbar', 'nav')}>{self.links(3, 9, self.rng.choice((' ', ' | ', ' &middot; ')))}</div>"
        if k == 2:
            return f"<ul><li>{self.links(3, 9, '<li>')}</ul>"
        if k == 3:
            return f"<table><tr><td>{self.links(2, 6, '</td><td>')}</td></tr></table>"
        return f"<header{self.name('top')}><a href=/>{self.words(1, 3)}</a><p>{self.words(1, 6)}</p>{self.links(1, 4, ' ')}</header>"

    def title(self) -> str:
        return f"<div{self.name('masthead', 'site-header', 'topbar')}><a href=/>{self.words(1, 3)}</a></div>"

    def foot(self) -> str:
        text = f"&copy; {self.rng.randint(1990, 2030)} {self.words(1, 3)}{self.rng.choice((". ", " "))}{self.rng.choice(('All rights reserved', 'Terms', 'Powered by ' + self.word(), ''))} {self.links(0, 4, ' ')}"
        return self.rng.choice((f"<footer>{text}</footer>", f"<div{self.name('footer')}>{text}</div>", f"<p>{text}</p>", f"<table><tr><td>{text}</td></tr></table>"))

    def aside(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3><ul><li>{self.links(2, 6, '</li><li>')}</li></ul>"
        return self.rng.choice((f"<aside>{inner}</aside>", f"<div{self.name('sidebar', 'related', 'widget', 'recommended-stories')}>{inner}</div>"))

    def notice(self) -> str:
        text = f"<p>{self.sentences(1, 2)}</p>"
        return self.rng.choice((f'<div class="{self.rng.choice(("cookie-notice", "ad", "banner", "newsletter-signup", "promo-box"))}">{text}</div>', f"<form action=/s><label>{self.words(1, 3)}</label><input name=q><button>{self.word()}</button></form>"))

    def comments(self) -> str:
        posts = "".join(f"<div><b>{self.word()}</b><p>{self.sentences(1, 4)}</p></div>" for _ in range(self.rng.randint(1, 5)))
        return f'<{(e := self.rng.choice(("div", "section")))} {self.rng.choice(("class", "id"))}="{self.rng.choice(("comments", "comment-list", "disqus"))}">{posts}</{e}>'

    def part(self) -> str:
        k = self.rng.randrange(10)
        if k < 5:
            text = self.sentences(1, 8)
            if self.rng.random() < 0.3:
                text += f' <a href="/{self.word()}">{self.words(1, 5)}</a> {self.sentences(0, 1)}'
            return f"<p>{text}" + self.rng.choice(("</p>", "</p>", ""))
        if k == 5:
            return f"<h2>{self.words(1, 7)}</h2><p>{self.sentences(1, 4)}</p>"
        if k == 6:
            return f"<ul><li>{'</li><li>'.join(self.words(1, 12) for _ in range(self.rng.randint(2, 6)))}</li></ul>"
        if k == 7:
            return f"<blockquote>{self.sentences(1, 3)}</blockquote>"
        if k == 8:
            return "<table>" + "".join(f"<tr><th>{self.words(1, 2)}</th><td>{self.words(1, 6)}</td></tr>" for _ in range(self.rng.randint(1, 4))) + "</table>"
        return f"<p>{self.words(1, 5)}</p>"

    def article(self) -> str:
        body = f"<h1>{self.words(1, 9)}</h1>" if self.rng.random() < 0.8 else ""
        body += "".join(self.part() for _ in range(self.rng.randint(1, 12)))
        k = self.rng.randrange(7)
        if k < 2:
            return f"<article>[+{body}+]</article>"
        if k == 2:
            return f"<main>[+{body}+]</main>"
        if k == 3:
            return f"<div{self.name('content', 'post', 'entry', 'story-body')}>[+{body}+]</div>"
        if k == 4:
            return f"<table><tr><td>{self.links(2, 5, '<br>')}</td><td>[+{body}+]</td></tr></table>"
        if k == 5:
            return f"<section{self.name('content', 'post')}>[+{body}+]</section>"
        return f"[+{body}+]"

    def whole(self) -> str:
        some = lambda p, f: f() if self.rng.random() < p else ""
        before = some(0.4, self.title) + some(0.85, self.menu) + some(0.3, self.notice) + some(0.15, self.aside)
        after = some(0.3, self.notice) + some(0.4, self.aside) + some(0.3, self.comments) + some(0.85, self.foot)
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style></head>" if self.rng.random() < 0.8 else ""
        return f"<!DOCTYPE html><html>{head}<body>{before}{self.article()}{after}</body></html>"


def labelled(n: int = 400, seed: int = 1) -> list[str]:
    return [Page(random.Random(f"{seed}:{k}")).whole() for k in range(n)]
