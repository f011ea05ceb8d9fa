"""Generated web pages with known main text, for training and testing the extractor."""

from __future__ import annotations

import random

SYLLABLES = [a + b for a in "b c d f g h l m n p r s t v st th br cl".split() for b in "a e i o u an en er in on al ou é ü".split()]
# Attribute texts of each part of a page; the empty one stands for none.
NAMES = {
    "menu": ("menu", "main-nav", "navbar", "site-navigation", "topnav", "breadcrumbs", "pagination", "", ""),
    "header": ("header", "site-header", "masthead", "top-bar", "branding", ""),
    "footer": ("footer", "site-footer", "colophon", "page-footer", "copyright", ""),
    "sidebar": ("sidebar", "side-column", "widget", "widget-area", "rail", "right-rail", ""),
    "ad": ("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner-ad"),
    "notice": ("cookie-notice", "notice", "alert", "consent", "newsletter", "subscribe-box", "popup", "gdpr-banner"),
    "comments": ("comments", "comment-list", "reader-comments", "discussion", "disqus_thread", "replies"),
    "related": ("related", "share", "social-links", "recommended", "more-stories", "tags", ""),
    "form": ("search", "login", "contact-form", "signup", ""),
    "content": ("content", "post", "entry-content", "article-body", "story", "main-text", "post-body", "", "", "c12", "x-col"),
    "wrap": ("wrapper", "container", "page", "row", "site", "", "", "inner"),
}


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: set[str] = set()

    def words(self, n: int, stop: bool = True) -> str:
        r = self.r
        out = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(max(1, n))]
        if stop:
            out = [w + r.choice(",.;") if r.random() < 0.12 else w for w in out]
        text = " ".join(out)
        return text[0].upper() + text[1:] + ("." if stop and r.random() < 0.85 else "")

    def attribute(self, part: str) -> str:
        name = self.r.choice(NAMES[part])
        if not name:
            return ""
        name = name if self.r.random() < 0.8 else f"{name} {self.r.choice(['clearfix', 'js-x', 'mb-3', 'block'])}"
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def element(self, tag: str, part: str, body: str) -> str:
        return f"<{tag}{self.attribute(part)}>{body}</{tag}>"

    def links(self, n: int, longest: int = 3) -> str:
        stop, most = self.r.random() < 0.4, self.r.choice([1, longest, longest])
        items = [f'<a href="/{self.words(1, False)}">{self.words(self.r.randint(1, most), stop)}</a>' for _ in range(n)]
        form = self.r.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" if form < 0.5 else f"<li>{i}" for i in items) + "</ul>"
        return (" | " if form < 0.8 else " ").join(items)

    def menu(self) -> str:
        tag = self.r.choice(["nav", "nav", "nav", "div", "ul"])
        if tag == "ul":
            return f'<ul class="{self.r.choice(["menu", "navigation", "nav"])}">' + "".join(f'<li><a href="#">{self.words(self.r.randint(1, 3), self.r.random() < 0.3)}</a>' for _ in range(self.r.randint(3, 9))) + "</ul>"
        return self.element(tag, "menu", self.links(self.r.randint(2, 9)))

    def ad(self) -> str:
        body = self.words(self.r.randint(2, 25))
        return self.element(self.r.choice(["div", "div", "div", "aside", "ins", "section"]), "ad", body if self.r.random() < 0.5 else f"<p>{body}</p>")

    def notice(self) -> str:
        body = f"<p>{self.words(self.r.randint(5, 40))}</p>" if self.r.random() < 0.6 else self.words(self.r.randint(5, 40))
        return self.element(self.r.choice(["div", "div", "section", "aside"]), "notice", body)

    def form(self) -> str:
        fields = []
        for _ in range(self.r.randint(1, 4)):
            label, note = self.words(self.r.randint(1, 6), False), self.words(self.r.randint(1, 12)) if self.r.random() < 0.5 else ""
            wrap = self.r.choice(["{}", "<p>{}</p>", "<div>{}</div>", "<li>{}</li>"])
            fields.append(wrap.format(f"<label>{label}</label><input type=text>{note}"))
        return f"<form{self.attribute('form')}>{''.join(fields)}<button>{self.words(1)}</button></form>"

    def related(self) -> str:
        title = f"<h3>{self.words(self.r.randint(1, 3), False)}</h3>" if self.r.random() < 0.7 else ""
        return self.element(self.r.choice(["div", "section", "aside", "ul"]).replace("ul", "div"), "related", title + self.links(self.r.randint(2, 8), 9))

    def sidebar(self) -> str:
        r = self.r
        parts = [r.choice([self.related, self.menu, self.ad, self.form, lambda: f"<h4>{self.words(2, False)}</h4><p>{self.words(r.randint(5, 50))}</p>"])() for _ in range(r.randint(1, 4))]
        return self.element(r.choice(["aside", "aside", "div"]), "sidebar", "".join(parts)) if r.random() < 0.85 else f'<aside>{"".join(parts)}</aside>'

    def comments(self) -> str:
        r = self.r
        item = r.choice(["li", "div", "article", "p"])
        each = []
        for _ in range(r.randint(1, 8)):
            body = f"<p>{self.words(r.randint(3, 60))}</p>" if item != "p" and r.random() < 0.7 else self.words(r.randint(3, 60))
            by = f'<b>{self.words(1, False)}</b> ' if r.random() < 0.6 else ""
            name = r.choice([' class="comment"', ' class="comment-body"', ""])
            each.append(f"<{item}{name}>{by}{body}</{item}>")
        body = f"<h2>{self.words(r.randint(1, 3), False)}</h2>" * (r.random() < 0.6) + ("<ol>" + "".join(each) + "</ol>" if item == "li" else "".join(each))
        return self.element(r.choice(["section", "div", "div"]), "comments", body)

    def kept(self, text: str) -> str:
        self.main.add(text)
        return text

    def inline(self, text: str) -> str:
        """The text with some of its words in inline elements, never changed."""
        words = text.split(" ")
        for _ in range(self.r.randint(0, 2)):
            i = self.r.randrange(len(words))
            if "<" not in words[i]:
                words[i] = self.r.choice(["<b>{}</b>", "<i>{}</i>", '<a href="/x">{}</a>', "<em>{}</em>", "<span>{}</span>"]).format(words[i])
        return " ".join(words)

    def paragraph(self) -> str:
        r = self.r
        text = self.inline(self.kept(self.words(r.choice([r.randint(1, 6), r.randint(6, 30), r.randint(20, 120)]))))
        form = r.random()
        return f"<p>{text}</p>" if form < 0.75 else f"<p>{text}" if form < 0.85 else f"<p><b>{text}<br>" if form < 0.95 else f"<div>{text}</div>"

    def article(self) -> str:
        r = self.r
        out = []
        if r.random() < 0.85:
            title = f"<h1>{self.kept(self.words(r.randint(1, 12), r.random() < 0.3))}</h1>"
            out.append(title if r.random() < 0.88 else f"<header>{title}</header>")
        for _ in range(r.choice([0, 1, r.randint(1, 6), r.randint(4, 25)])):
            form = r.random()
            if form < 0.78:
                out.append(self.paragraph())
            elif form < 0.84:
                out.append(f"<h{r.randint(2, 4)}>{self.kept(self.words(r.randint(1, 8), False))}</h2>")
            elif form < 0.89:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{self.inline(self.kept(self.words(r.randint(1, 25))))}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>")
            elif form < 0.92:
                out.append(f"<blockquote>{self.kept(self.words(r.randint(5, 40)))}</blockquote>")
            elif form < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.kept(self.words(r.randint(1, 4), False))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif form < 0.96:
                out.append(f"<pre>{self.kept(self.words(r.randint(4, 30), False))}</pre>")
            else:
                out.append(r.choice([self.ad, self.ad, self.related, self.notice, self.form])())
        if not self.main:
            out.append(self.paragraph())
        tail = "".join(r.choice([self.related, self.form, self.ad])() for _ in range(r.random() < 0.15))
        inside = self.comments() if r.random() < 0.06 else ""
        body = "".join(out) + tail + inside
        form = r.random()
        if form < 0.04:
            return body  # straight in whatever holds it
        if form < 0.48:
            return f"<article{self.attribute('content') if r.random() < 0.4 else ''}>{body}</article>"
        if form < 0.6:
            return f"<main{self.attribute('content') if r.random() < 0.4 else ''}>{body}</main>"
        if form < 0.68:
            return f"<main><article>{body}</article></main>"
        if form < 0.95:
            return self.element(r.choice(["div", "div", "section"]), "content", body)
        return f"<table><tr><td>{body}</td></tr></table>" if "<table" not in body else f"<div>{body}</div>"

    def page(self) -> str:
        r = self.r
        some = lambda p, f: f() if r.random() < p else ""
        top = []
        for p, f in ((0.3, self.notice), (0.45, self.header), (0.75, self.menu), (0.45, self.ad), (0.15, self.form)):
            top.append(some(p, f))
        if r.random() < 0.3:
            r.shuffle(top)
        side = some(0.4, self.sidebar)
        after = [some(0.3, self.related), some(0.35, self.comments), some(0.2, self.ad)]
        article = self.article() if r.random() < 0.93 else ""
        middle = side + article + "".join(after) if r.random() < 0.4 else article + "".join(after) + side
        if r.random() < 0.4:
            middle = self.element("div", "wrap", middle)
        bottom = some(0.8, self.footer) + some(0.1, self.notice)
        body = "".join(top) + middle + bottom
        if r.random() < 0.3:
            body = self.element("div", "wrap", body)
        noise = '<script>var t="</p>";</script><!-- ad -->' if r.random() < 0.5 else ""
        whole = f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{}}</style></head><body>{noise}{body}</body></html>"
        return whole[: -len("</body></html>")] if r.random() < 0.1 else whole

    def header(self) -> str:
        r = self.r
        inner = r.choice([lambda: f"<h1>{self.words(r.randint(1, 4), False)}</h1>", lambda: f"<p>{self.words(r.randint(1, 12))}</p>", lambda: self.words(r.randint(1, 6), False)])()
        inner += self.menu() if r.random() < 0.5 else self.form() if r.random() < 0.2 else ""
        return f"<header{self.attribute('header')}>{inner}</header>" if r.random() < 0.6 else f'<div class="{r.choice(["header", "masthead", "site-header", "top-bar", "branding"])}">{inner}</div>'

    def footer(self) -> str:
        r = self.r
        inner = r.choice([lambda: f"&copy; {self.words(1, False)} &middot; {self.words(r.randint(2, 14))}", lambda: f"<p>{self.words(r.randint(3, 30))}</p>", lambda: self.links(r.randint(2, 6))])()
        return f"<footer{self.attribute('footer') if r.random() < 0.4 else ''}>{inner}</footer>" if r.random() < 0.7 else f'<div class="{r.choice(["footer", "site-footer", "colophon", "copyright"])}">{inner}</div>'


def training_page(seed: int) -> tuple[str, set[str]]:
    """A page's source and the set of its main blocks."""
    writer = Writer(seed)
    return writer.page(), writer.main
