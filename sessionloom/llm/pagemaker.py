"""Labelled web pages for training: pages composed from parts whose place is known.

Sites differ in where the article stands, in the names of their elements, in what
surrounds it and in how careful their markup is.
"""

from __future__ import annotations

import html
import random

_SYLLABLES = "ka lo mi ra ten sul por eda vin che oru ma tis len gor pa qui ber sto na ün ça zé".split()


class Site:
    """One random page; ``main`` collects the texts of its main blocks."""

    def __init__(self, r: random.Random) -> None:
        self.r, self.main, self.vocab = r, set(), ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(300)]

    def words(self, a: int, b: int, stop: str = "") -> str:
        w = [self.r.choice(self.vocab) + ("," if self.r.random() < 0.08 else ".### &"[0] * (self.r.random() < 0.1)) for _ in range(self.r.randint(a, b))]
        return (w[0].capitalize() + " " + " ".join(w[1:])).strip() + stop

    def text(self, s: str, main: bool) -> str:
        """The text as markup; main texts are noted as they will be read back."""
        if main:
            self.main.add(" ".join(s.split()))
        out = html.escape(s, quote=False)
        if self.r.random() < 0.2:
            parts = out.split(" ")
            i = self.r.randrange(len(parts))
            tag = self.r.choice(["b", "i", "em", "strong", "span", 'a href="/x"', "code"])
            if not parts[i].count("&"):
                parts[i] = f"<{tag}>{parts[i]}</{tag.split()[0]}>"
            out = " ".join(parts)
        return out

    def links(self, n: int, sizes=(1, 3)) -> str:
        return "".join(f'<li><a href="/{k}">{self.text(self.words(*sizes), False)}</a></li>' for k in range(n))

    def name(self, *options: str) -> str:
        n = self.r.choice(options)
        n = self.r.choice([n, f"{n}-{self.r.choice(['wrap', 'box', 'inner', 'area', '1'])}", f"{self.r.choice(['site', 'page', 'x', 'c'])}-{n}"])
        return f' {self.r.choice(["class", "id"])}="{n}"'

    def box(self, tags: tuple[str, ...], names: tuple[str, ...], inner: str) -> str:
        tag = self.r.choice(tags)
        name = self.name(*names) if tag in ("div", "section") or self.r.random() < 0.5 else ""
        return f"<{tag}{name}>{inner}</{tag}>"

    def sentence(self, a: int, b: int) -> str:
        return self.text(self.words(a, b, "."), False)

    def surrounding(self, kind: str) -> str:
        r = self.r
        p = lambda a, b: f"<p>{self.sentence(a, b)}</p>" if r.random() < 0.6 else self.sentence(a, b)
        if kind == "nav":
            return self.box(("nav", "div", "ul"), ("nav", "menu", "navbar", "topmenu", "navigation"), f"<ul>{self.links(r.randint(2, 9))}</ul>" if r.random() < 0.8 else self.sentence(1, 3))
        if kind == "header":
            return self.box(("header", "div"), ("header", "masthead", "banner", "logo", "topbar"), f"<{(h := r.choice(['h1', 'h2', 'div', 'p', 'span']))}>{self.text(self.words(1, 4), False)}</{h}>" + (p(2, 9) if r.random() < 0.5 else ""))
        if kind == "crumbs":
            return self.box(("div", "ol", "nav"), ("breadcrumb", "crumbs", "breadcrumbs"), self.links(r.randint(1, 4)))
        if kind == "ad":
            return self.box(("div", "aside", "section"), ("ad", "ads", "advert", "sponsored", "promo", "banner", "adsense"), p(4, 40))
        if kind == "side":
            return self.box(("aside", "div"), ("sidebar", "side", "widget", "related", "recommended", "rail"), (f"<h3>{self.text(self.words(1, 3), False)}</h3>" if r.random() < 0.7 else "") + (f"<ul>{self.links(r.randint(2, 6), (2, 8))}</ul>" if r.random() < 0.6 else "".join(p(5, 30) for _ in range(r.randint(1, 3)))))
        if kind == "notice":
            return self.box(("div", "section", "aside"), ("cookie", "notice", "consent", "gdpr", "alert", "popup", "newsletter", "subscribe"), p(5, 45) + (f"<button>{self.text(self.words(1, 2), False)}</button>" if r.random() < 0.5 else ""))
        if kind == "form":
            return f"<form{self.name('search', 'login', 'signup', 'contact', 'subscribe')}>" + "".join(f"<label>{self.text(self.words(1, 4), False)}</label><input name=x><p>{self.sentence(2, 25)}</p>" for _ in range(r.randint(1, 3))) + f"<button>{self.text(self.words(1, 2), False)}</button></form>"
        if kind == "script":
            return f"<noscript>{p(3, 25)}</noscript>"
        if kind == "choice":
            return f"<select name=x>" + "".join(f"<option>{self.text(self.words(1, 3), False)}" for _ in range(r.randint(1, 6))) + r.choice(["</select>", "</select>", ""])
        if kind == "icon":
            return f"<div{self.name('icon', 'logo', 'button')}><svg><title>{self.text(self.words(1, 3), False)}</title><text>{self.text(self.words(1, 3), False)}</text>" + r.choice(["<path d='M0'/></svg>", "<path d='M0'>", ""]) + "</div>"
        if kind == "share":
            return self.box(("div", "ul"), ("share", "social", "tags", "toolbar"), self.links(r.randint(2, 5), (1, 2)))
        if kind == "comments":
            one = lambda: self.box(("div", "article", "li"), ("comment", "reply", "response", "comment-body"), f"<cite>{self.text(self.words(1, 2), False)}</cite>" + "".join(f"<p>{self.sentence(3, 60)}</p>" for _ in range(r.randint(1, 2))))
            return self.box(("section", "div", "ol"), ("comments", "responses", "disqus", "commentlist", "replies"), (f"<h3>{self.text(self.words(1, 3), False)}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 5))))
        return self.box(("footer", "div"), ("footer", "foot", "copyright", "legal", "bottom"), f"{r.choice(['&copy; ', '', '&#169; 2020 '])}{self.text(self.words(1, 4), False)} &middot; {self.sentence(2, 30)}" if r.random() < 0.7 else p(3, 40) + f"<ul>{self.links(r.randint(2, 6))}</ul>")

    def article(self) -> str:
        r, out = self.r, []
        close = (lambda t: f"</{t}>") if r.random() < 0.7 else (lambda t: "" if t in ("p", "li") else f"</{t}>")
        if r.random() < 0.8:
            out.append(f"<h1>{self.text(self.words(2, 14), True)}</h1>")
        style = r.random()
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            kind = r.random()
            size = r.choice([(1, 4), (5, 15), (15, 60), (40, 160)])
            if style < 0.12:
                out.append(f"<div>{self.text(self.words(*size, '.'), True)}</div>")
            elif kind < 0.72:
                lead = "<b>" if r.random() < 0.08 else ""  # never closed
                tail = "<br>" if r.random() < 0.1 else ""
                out.append(f"<p>{lead}{self.text(self.words(*size, r.choice(['.', '', '.', '!'])), True)}{tail}" + ("" if tail else close("p")))
            elif kind < 0.8:
                out.append(f"<h2>{self.text(self.words(1, 8), True)}</h2>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{self.text(self.words(2, 25), True)}{close('li')}" for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.93:
                out.append(f"<blockquote>{self.text(self.words(6, 40, '.'), True)}</blockquote>")
            elif kind < 0.97:
                out.append(f"<pre>{self.text(self.words(4, 30), True)}</pre>")
            else:
                out.append("<table><tr>" + "".join(f"<td>{self.text(self.words(1, 6), True)}</td>" for _ in range(3)) + "</tr></table>")
            if r.random() < 0.06:  # what stands for an embedded thing
                tag = r.choice(["object", "video", "audio", "canvas", "noscript"])
                out.append(f"<{tag}><p>{self.text(self.words(3, 30, '.'), True)}</p></{tag}>")
            if r.random() < 0.05:
                out.append(self.surrounding(r.choice(["ad", "share", "side", "notice", "form", "choice", "icon"])))
        body = "".join(out)
        how = r.random()
        if how < 0.45:
            return f"<article{self.name('post', 'story', 'entry') if r.random() < 0.3 else ''}>{body}</article>"
        if how < 0.85:
            return self.box(("div", "section", "main"), ("content", "article", "post", "entry", "story", "main", "text", "article-body", "post-content"), body)
        if how < 0.93:
            return f"<main>{body}</main>"
        return f"<div>{body}</div>"

    def bare(self) -> str:
        """A page of text with no or few names: in the body itself, in a plain element, or beside one or two parts."""
        r = self.r
        body = "".join(f"<p>{self.text(self.words(*r.choice([(8, 30), (30, 120)]), '.'), True)}{r.choice(['</p>', '</p>', ''])}" for _ in range(r.choice([1, 1, 2, 4, 9])))
        if r.random() < 0.4:
            body = f"<h1>{self.text(self.words(1, 9), True)}</h1>" + body
        if r.random() < 0.15:
            body = self.text(self.words(20, 90, "."), True)
        for tag in r.choice([(), (), ("div",), ("div",), ("div", "div"), ("section",), ("section",), ("main",), ("table", "tr", "td"), ("center",)]):
            body = f"<{tag}>{body}</{tag}>"
        if r.random() < 0.4:
            body = self.surrounding(r.choice(["nav", "header", "crumbs", "form", "script", "choice", "icon"])) + body
        if r.random() < 0.4:
            body += self.surrounding(r.choice(["footer", "footer", "comments", "share", "nav"]))
        return r.choice(["", "<html><body>", "<!DOCTYPE html><html><head><title>x</title></head><body>"]) + body

    def page(self) -> str:
        r = self.r
        if r.random() < 0.2:
            return self.bare()
        some = lambda kinds, k: [self.surrounding(r.choice(kinds)) for _ in range(k)]
        before = some(["nav", "header", "crumbs", "ad", "notice", "form", "side", "nav", "script", "icon"], r.randint(1, 5))
        after = some(["comments", "side", "share", "ad", "form", "notice", "nav", "choice"], r.randint(0, 4)) + ([self.surrounding("footer")] if r.random() < 0.9 else [])
        inside = before + [self.article()] + after
        if r.random() < 0.3:
            inside = ["<div" + self.name("wrapper", "container", "page") + ">", *inside, "</div>"]
        head = f'<!DOCTYPE html><html lang="x"><head><meta charset="utf-8"><title>{self.text(self.words(2, 9), False)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        tail = "" if r.random() < 0.15 else "</body></html>"
        return head + r.choice(["", "\n"]).join(inside) + tail


def labelled_pages(n: int, seed: int) -> list[tuple[str, set[str]]]:
    """(html, texts of the main blocks) of n pages."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        site = Site(r)
        out.append((site.page(), site.main))
    return out
