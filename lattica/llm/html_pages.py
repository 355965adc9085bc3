"""Web pages made by rule, with their main text known: what the extractor learns from."""

from __future__ import annotations

import html
import random

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo ya zu an er in on th st ch sch ción é ü ñ tion ment ing ly".split()
_MAIN = "article post entry content story main body text prose page single blog news document".split()
_MENU = "nav navbar menu navigation top links breadcrumb breadcrumbs pagination pager tabs toc skip".split()
_HEAD = "header masthead banner brand site topbar logo branding".split()
_FOOT = "footer copyright bottom legal colophon foot credits".split()
_SIDE = "sidebar side aside widget related recommended popular trending more archive tags rail secondary".split()
_ADS = "ad ads advert advertisement sponsor sponsored promo banner adsense dfp outbrain commercial".split()
_NOTE = "cookie consent notice banner gdpr alert popup modal overlay announcement paywall newsletter subscribe".split()
_SHARE = "share social sharing follow buttons meta byline".split()
_FORM = "form search login signup contact newsletter subscribe field input".split()
_REPLY = "comment comments reply replies discussion respond disqus thread commentlist responses reviews".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: set[str] = set()

    def words(self, a: int, b: int) -> str:
        r = self.r
        out = ["".join(r.choices(_SYLLABLES, k=r.choice((1, 1, 2, 2, 3)))) for _ in range(r.randint(a, b))]
        style = r.random()
        if style < 0.08:  # junk writing also stands in articles
            out = [w + r.choice(("***", "$$$", "###", "%%%", "&&&")) for w in out]
        elif style < 0.12:
            out = [w.upper() + "!!" for w in out]
        text, rest = "", 0
        for w in out:
            if rest <= 0:
                text, rest = (text + ". " if text else "") + w.capitalize(), r.randint(3, 18)
            else:
                text += (", " if r.random() < 0.08 else " ") + w
            rest -= 1
        return text + "."

    def names(self, pool: list[str]) -> str:
        r = self.r
        if r.random() < 0.1:
            return f' class="c{r.randint(1, 99)}"'
        picked = [r.choice(pool)]
        if r.random() < 0.4:
            picked.append(r.choice(("inner", "wrap", "box", "block", "area", "list", "item", "row", "col", *pool)))
        glue = r.choice(("-", "_", " "))
        return f' {r.choice(("class", "class", "class", "id"))}="{glue.join(picked)}"'

    def keep(self, text: str) -> str:
        self.main.add(" ".join(text.split()))
        return html.escape(text, quote=False)

    def links(self, n: int, a: int = 1, b: int = 4) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(a, b).rstrip(".")}</a></li>' for i in range(n))

    def menu(self) -> str:
        tag = self.r.choice(("nav", "nav", "div", "ul"))
        items = self.links(self.r.randint(1, 12), 1, 2)
        return f"<{tag}{self.names(_MENU) if tag != 'nav' or self.r.random() < 0.5 else ''}>{items if tag == 'ul' else '<ul>' + items + '</ul>'}</{tag}>"

    def advert(self) -> str:
        tag = self.r.choice(("div", "div", "aside", "section"))
        inner = self.words(3, 30)
        return f"<!-- ad --><{tag}{self.names(_ADS)}>{inner if self.r.random() < 0.6 else f'<p>{inner}</p>'}</{tag}>"

    def side(self) -> str:
        tag, r = self.r.choice(("aside", "aside", "div", "section")), self.r
        parts = [f"<h3>{self.words(1, 4)}</h3>", f"<ul>{self.links(r.randint(2, 8), 2, 9)}</ul>", f"<p>{self.words(5, 60)}</p>"]
        return f"<{tag}{self.names(_SIDE) if tag != 'aside' or r.random() < 0.6 else ''}>{''.join(r.sample(parts, r.randint(1, 3)))}</{tag}>"

    def notice(self) -> str:
        link = f' <a href="#">{self.words(1, 2)}</a>' if self.r.random() < 0.5 else ""
        return f"<div{self.names(_NOTE)}><p>{self.words(5, 40)}{link}</p></div>"

    def form(self) -> str:
        return f"<form{self.names(_FORM) if self.r.random() < 0.7 else ''}><label>{self.words(1, 6)}</label><input name=q><p>{self.words(2, 20)}</p><button>Go</button></form>"

    def share(self) -> str:
        return f"<div{self.names(_SHARE)}>{self.words(1, 3)} <a href=#>{self.words(1, 1)}</a> <a href=#>{self.words(1, 1)}</a></div>"

    def replies(self) -> str:
        r, tag = self.r, self.r.choice(("div", "section", "div"))
        one = lambda: f"<{r.choice(('div', 'li', 'article'))}{self.names(_REPLY)}><b>{self.words(1, 2)}</b> <p>{self.words(4, 90)}</p>"
        said = ""
        for _ in range(r.randint(1, 7)):
            c = one()
            said += c + f"</{c[1 : min(c.find(' '), c.find('>'))]}>"
        head = f"<h3>{self.words(1, 3)}</h3>" if r.random() < 0.6 else ""
        return f"<{tag}{self.names(_REPLY)}>{head}{said}</{tag}>"

    def top(self) -> str:
        tag = self.r.choice(("header", "header", "div"))
        title = f"<{self.r.choice(('h1', 'h2', 'p', 'div'))}>{self.words(1, 5)}"
        return f"<{tag}{self.names(_HEAD) if tag == 'div' or self.r.random() < 0.5 else ''}>{title}</{title[1 : title.find('>')]}>{self.menu() if self.r.random() < 0.5 else ''}</{tag}>"

    def foot(self) -> str:
        tag, r = self.r.choice(("footer", "footer", "div")), self.r
        mark = r.choice(("&copy; ", "Copyright ", ""))
        text = f"{mark}{self.words(1, 3)} &middot; {self.words(2, 25)}"
        return f"<{tag}{self.names(_FOOT) if tag == 'div' or r.random() < 0.4 else ''}>{text if r.random() < 0.6 else f'<p>{text}</p>'}{f'<ul>{self.links(r.randint(1, 5))}</ul>' if r.random() < 0.4 else ''}</{tag}>"

    def block(self) -> str:
        """One block of an article."""
        r, kind = self.r, self.r.random()
        text = self.keep(self.words(1, r.choice((4, 12, 40, 90, 160))))
        if kind < 0.62:
            return f"<p>{text}" + r.choice(("</p>", "</p>", "</p>", ""))
        if kind < 0.68:
            return f"<p><b>{text}<br>"
        if kind < 0.74:
            return f"<h{(n := r.randint(2, 4))}>{self.keep(self.words(1, 8))}</h{n}><p>{text}</p>"
        if kind < 0.80:
            return f"<ul>{''.join(f'<li>{self.keep(self.words(2, 25))}</li>' for _ in range(r.randint(1, 6)))}</ul><p>{text}</p>"
        if kind < 0.85:
            return f"<blockquote><p>{text}</p></blockquote>" if r.random() < 0.6 else f"<blockquote>{text}</blockquote>"
        if kind < 0.89:
            rows = "".join(f"<tr><td>{self.keep(self.words(1, 4))}</td><td>{self.keep(self.words(1, 6))}</td></tr>" for _ in range(r.randint(1, 4)))
            return f"<table>{rows}</table><p>{text}</p>"
        if kind < 0.92:
            return f"<figure><img src=x.png><figcaption>{text}</figcaption></figure>"
        if kind < 0.95:
            return f"<pre>{text}</pre>"
        return f"<div>{text}</div>"

    def article(self) -> str:
        r = self.r
        parts = [f"<h1>{self.keep(self.words(2, 12))}</h1>"] if r.random() < 0.85 else []
        parts += [self.block() for _ in range(r.choice((1, 2, 3, 4, 6, 8, 12, 18)))]
        for made in (self.advert, self.share, self.side, self.notice, self.form):
            if r.random() < 0.12:
                parts.insert(r.randint(1, len(parts)), made())
        if r.random() < 0.1:
            parts.append(self.replies())
        body = "".join(parts)
        tag = r.choice(("article", "article", "article", "main", "div", "section", "div"))
        named = self.names(_MAIN) if tag in ("div", "section") or r.random() < 0.4 else ""
        out = f"<{tag}{named}>{body}</{tag}>"
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            out = f"<div{self.names([*_MAIN, 'container', 'wrapper', 'layout', 'grid'])}>{out}</div>"
        return out

    def page(self) -> str:
        r = self.r
        chance = lambda made, p: [made()] if r.random() < p else []
        before = chance(self.notice, 0.2) + chance(self.top, 0.45) + chance(self.menu, 0.7) + chance(self.form, 0.15) + chance(self.advert, 0.5) + chance(self.side, 0.15)
        after = chance(self.share, 0.15) + chance(self.replies, 0.3) + chance(self.side, 0.35) + chance(self.advert, 0.2) + chance(self.form, 0.15) + chance(self.foot, 0.8) + chance(self.notice, 0.1)
        article = self.article() if r.random() < 0.96 else ""
        inner = "".join(before) + article + "".join(after)
        if r.random() < 0.3:
            inner = f'<div id="{r.choice(("page", "wrapper", "root", "app", "container"))}">{inner}</div>'
        return f'<!DOCTYPE html><html lang="en"><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style></head><body>{inner}' + r.choice(("</body></html>", "</body></html>", ""))


def labelled(n: int, seed: int) -> list[tuple[str, set[str]]]:
    """(page, the texts of its main blocks), n times."""
    out = []
    for i in range(n):
        maker = Maker(seed * 1_000_003 + i)
        out.append((maker.page(), maker.main))
    return out
