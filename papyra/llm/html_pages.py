"""Pages with known main text, drawn from a grammar of layouts, to train the block labeller on."""

from __future__ import annotations

import html
import random

#: Names that sites give to what is and what is not the article (fixed values).
MAIN = ["article", "post", "content", "entry-content", "story", "main", "article-body", "text", "post-body"]
NOISE = {
    "nav": ["nav", "menu", "navbar", "breadcrumbs", "toc-menu", "navigation", "topbar"],
    "header": ["header", "masthead", "site-header", "banner", "branding", "logo"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "legal", "colophon"],
    "aside": ["sidebar", "aside", "related", "widget", "rail", "recommended", "trending"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "sponsor"],
    "notice": ["cookie", "notice", "consent", "cookie-notice", "gdpr", "alert", "newsletter", "subscribe", "popup", "modal"],
    "comments": ["comments", "comment", "comment-list", "replies", "discussion", "disqus", "reader-comments"],
    "form": ["form", "search", "login", "signup", "contact-form", "search-box"],
    "share": ["share", "social", "buttons", "tags", "byline-links", "pager"],
}
SAID = {
    "nav": "home about contact news products blog archive sign in help",
    "header": "welcome the daily site menu search log in",
    "footer": "copyright all rights reserved privacy policy terms of use imprint contact",
    "aside": "related articles most read popular recommended more stories latest",
    "ad": "advertisement sponsored buy now sale free shipping offer discount click here",
    "notice": "we use cookies accept this site uses subscribe to our newsletter sign up enable javascript",
    "comments": "comments reply says wrote posted thanks great post i agree anonymous likes",
    "form": "name email search submit password send your message",
    "share": "share tweet facebook print email this tags next previous",
}


class Pages:
    def __init__(self, seed: int):
        self.r, self.bare = random.Random(seed), False
        syllables = [c + v + e for c in "bcdfghlmnprstvz" for v in "aeiou" for e in ("", "n", "r", "s", "t")] + ["the", "and", "er", "tion", "ing", "ch", "ê", "ñ", "ü", "é", "ß"]
        self.syllables = syllables

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def prose(self, n: int) -> str:
        out, up = [], True
        junk = self.r.choice(["%%%", "***", "&&&"]) if self.r.random() < 0.08 else ""
        for _ in range(n):
            w = self.word()
            w = w.capitalize() if up else w
            up = self.r.random() < 0.1
            out.append(w + ("." if up else "," if self.r.random() < 0.05 else "") + junk)
        return " ".join(out).rstrip(",") + ("" if self.r.random() < 0.15 else ".")

    def short(self) -> int:
        return self.r.choice((1, 2, 3, 5, 8, 12, 20))

    def attrs(self, names: list[str], rate: float = 0.8) -> str:
        if self.bare:  # names that say nothing, or none
            return "" if self.r.random() < 0.5 else f' class="{self.word()}"'
        if self.r.random() > rate:
            return ""
        return f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(names)}"'

    def inline(self, text: str, links: float) -> str:
        words = [html.escape(w) for w in text.split(" ")]
        for i in range(len(words)):
            x = self.r.random()
            if x < links:
                words[i] = f'<a href="/{self.word()}">{words[i]}</a>'
            elif x < links + 0.02:
                words[i] = f"<b>{words[i]}</b>"
        return " ".join(words)

    def noise(self, kind: str) -> list[tuple[str, int]]:
        """Pieces of markup; label 0 text."""
        r = self.r
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        tag = r.choice((tag, tag, "div", "section")) if kind != "comments" else r.choice(("div", "section", "ul", "ol"))
        named = self.attrs(NOISE[kind], 1.0 if tag in ("div", "section", "ul", "ol") else 0.4)
        say = lambda n: " ".join(r.choice(SAID[kind].split()) if r.random() < 0.5 else self.word() for _ in range(n))
        out = [(f"<{tag}{named}>", -1)]
        if kind in ("nav", "share") and r.random() < (0.5 if self.bare else 0.1):
            between = r.choice((" | ", " ", " - ", "<br>"))
            out.append((between.join(f'<a href="/{self.word()}">{html.escape(say(r.randint(1, 3)))}</a>' for _ in range(r.randint(2, 7))), 0))
        elif kind in ("nav", "share") or kind in ("aside", "footer") and r.random() < 0.4:
            out.append(("<ul>", -1))
            for _ in range(r.randint(2, 9)):
                text = say(r.randint(1, 3)) if r.random() < 0.5 else self.word()
                out += [("<li>", -1), (f'<a href="/{text.split()[0]}">{html.escape(text)}</a>', 0), ("</li>", -1)]
            out.append(("</ul>", -1))
        elif kind == "comments":
            item = "li" if tag in ("ul", "ol") else r.choice(("div", "p", "article"))
            for _ in range(r.randint(1, 6)):
                body = self.prose(r.randint(3, 60))
                out += [(f"<{item}{self.attrs(NOISE['comments'], 0.7)}>", -1), (html.escape(body if r.random() < 0.6 else say(4) + " " + body), 0), (f"</{item}>", -1)]
        elif kind == "form":
            for _ in range(r.randint(1, 4)):
                out += [("<label>" if r.random() < 0.5 else "<p>", -1), (html.escape(say(r.randint(1, 4))), 0), ('<input type="text">', -1)]
            out += [("<button>", -1), (say(1), 0), ("</button>", -1)]
        else:
            for _ in range(r.randint(1, 3)):
                mark = r.choice(("p", "", "span", "h3", "div"))
                text = self.prose(self.short()) if r.random() < (0.1 if self.bare else 0.55) else say(self.short())
                if kind == "footer" and r.random() < 0.5:
                    text = "© " + text
                text = self.inline(text, 0.2 if r.random() < 0.3 else 0.0)
                out += [(f"<{mark}>" if mark else "", -1), (text, 0), (f"</{mark}>" if mark else "", -1)]
        return [*out, (f"</{tag}>", -1)]

    def main(self) -> list[tuple[str, int]]:
        r = self.r
        tag = r.choice(("div", "div", "section", "td")) if self.bare else r.choice(("article", "article", "article", "main", "div", "div", "section", "td"))
        named = self.attrs(MAIN, 0.35 if tag in ("article", "main") else 1.0)
        # paragraphs as such, or as divisions
        start, end = ("<p>", "</p>") if r.random() < (0.6 if self.bare else 0.93) else (f"<div{self.attrs(MAIN, 0.3)}>", "</div>")
        out = [(f"<{tag}{named}>", -1)]
        if r.random() < 0.85:
            h = r.choice(("h1", "h1", "h2"))
            out += [(f"<{h}>", -1), (html.escape(self.prose(self.short())), 1), (f"</{h}>", -1)]
        sloppy = r.random() < 0.4
        for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            x = r.random()
            if x < 0.72:
                text = self.inline(self.prose(r.choice((10, 15, 25, 50, 90) if self.bare else (1, 2, 4, 10, 25, 50, 90, 150))), r.choice((0, 0, 0, 0.03)))
                text = ("<b>" + text + ("<br>" if r.random() < 0.7 else "")) if sloppy and r.random() < 0.3 else text
                out += [(start, -1), (text, 1), ("" if sloppy and start == "<p>" and r.random() < 0.4 else end, -1)]
            elif x < 0.8:
                h = r.choice(("h2", "h3"))
                out += [(f"<{h}>", -1), (html.escape(self.prose(self.short())), 1), (f"</{h}>", -1)]
            elif x < 0.87:
                kind = r.choice(("ul", "ol"))
                out.append((f"<{kind}>", -1))
                for _ in range(r.randint(2, 5)):
                    out += [("<li>", -1), (html.escape(self.prose(r.randint(2, 25))), 1), ("</li>", -1)]
                out.append((f"</{kind}>", -1))
            elif x < 0.92:
                kind = r.choice(("blockquote", "pre", "figcaption", "div"))
                out += [(f"<{kind}>", -1), (html.escape(self.prose(r.randint(4, 40))), 1), (f"</{kind}>", -1)]
            elif x < 0.95:
                out += [("<table><tr><td>", -1), (self.word(), 1), ("</td><td>", -1), (self.prose(3), 1), ("</td></tr></table>", -1)]
            else:
                out += self.noise(r.choice(("ad", "ad", "aside", "share", "notice", "form")))
        if r.random() < 0.15:
            out += self.noise("comments")
        return [*out, (f"</{tag}>", -1)]

    def page(self) -> list[tuple[str, int]]:
        """Pieces (markup or text, label): 1 article, 0 other text, -1 markup that holds no text."""
        r = self.r
        out = [("<!DOCTYPE html><html><head><meta charset=utf-8><title>", -1), (html.escape(self.prose(self.short())), 0), ("</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>", -1)]
        wrap, self.bare = r.random() < 0.3, r.random() < 0.3
        cells = self.bare and r.random() < 0.25
        out.append(("<div id=\"page\">" if wrap else "", -1))
        before = ["nav", "header", "ad", "notice", "form", "aside", "share"]
        after = ["footer", "aside", "comments", "ad", "notice", "form", "nav", "share"]

        def around(block: list[tuple[str, int]]) -> list[tuple[str, int]]:
            """In a table's row, in divisions that say nothing, or as it is."""
            if cells:
                return [("<table><tr><td>", -1), *block, ("</td></tr></table>", -1)]
            deep = r.choice((0, 0, 1, 2, 3)) if self.bare else 0
            return [*((f"<div{self.attrs(MAIN)}>", -1) for _ in range(deep)), *block, *(("</div>", -1) for _ in range(deep))]

        for kind in r.sample(before, r.randint(0, 4)):
            out += around(self.noise(kind))
        out += around(self.main())
        for kind in [*r.sample(after[1:], r.randint(0, 4)), *(["footer"] if r.random() < 0.7 else [])]:
            named, self.bare = self.bare, self.bare and kind != "comments"  # nothing else tells comments from prose
            out += around(self.noise(kind))
            self.bare = named
        self.bare = False
        return [*out, ("</div>" if wrap else "", -1), ("</body></html>" if r.random() < 0.9 else "", -1)]
