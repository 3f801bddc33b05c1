"""Generated web pages with a label for every block, to train the block labeller on."""

import numpy as np

from vintagepanel.llm.html_text import Block, blocks

#: Marks text that belongs to the article; taken out again once the page is parsed.
MARK = "\ue000"
# words that name parts of pages, in the notations met on the web
NAMES = {
    "header": ["header", "masthead", "topbar", "site-header", "branding", "page-header", "top", "hero", "logo"],
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "main-menu", "topnav", "tabs", "pagination", "skip-links"],
    "notice": ["notice", "cookie", "cookie-banner", "consent", "alert", "gdpr", "banner", "modal", "popup", "newsletter", "subscribe", "paywall", "warning", "message"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "ad-slot", "banner-ad", "adsbygoogle", "teaser", "promotion"],
    "side": ["sidebar", "side", "widget", "related", "popular", "recent", "trending", "more", "recommended", "aside", "rail", "tags", "archive"],
    "share": ["share", "social", "share-buttons", "sharing", "follow", "toolbar", "actions"],
    "comments": ["comments", "comment-list", "responses", "discussion", "replies", "reader-comments", "disqus", "respond", "feedback", "comment-section", "comment"],
    "footer": ["footer", "copyright", "bottom", "site-footer", "colophon", "legal", "page-footer", "credits"],
    "form": ["form", "search", "login", "signup", "contact-form", "search-form", "subscribe-form"],
    "content": ["content", "post", "entry", "article", "story", "article-body", "post-content", "entry-content", "main-content", "text", "body", "page-content", "story-body", "hentry", "prose"],
    "wrap": ["container", "wrapper", "page", "main", "row", "col", "layout", "inner", "site", "outer", "grid"],
}
SAYINGS = {
    "notice": ["We use cookies to improve your experience.", "This site uses cookies. Accept", "Sign up for our newsletter", "Please enable JavaScript to continue.", "You have read 3 of 5 free articles."],
    "ad": ["Advertisement", "Sponsored", "Buy now and save 20%!", "Shop the sale today.", "Limited offer. Order today!"],
    "side": ["Related articles", "Most read", "Popular posts", "Recent posts", "Categories", "Tags", "Archives", "You may also like"],
    "share": ["Share", "Tweet", "Share this page", "Print", "Email", "Follow us"],
    "comments": ["Comments", "3 comments", "Leave a reply", "Reply", "Log in to comment", "Join the discussion"],
    "footer": ["All rights reserved.", "Privacy policy", "Terms of use", "Contact us", "Imprint", "About"],
    "form": ["Search", "Submit", "Email address", "Password", "Log in", "Name", "Message", "Send"],
    "nav": ["Home", "About", "Contact", "Blog", "News", "Next", "Previous", "Products"],
    "header": ["Welcome", "The daily", "Menu", "Skip to content"],
}
_SYLLABLES = ["the", "an", "er", "in", "tion", "ea", "on", "st", "re", "nd", "ou", "le", "de", "ch", "en", "ei", "ung", "es", "ar", "ci", "do", "qu", "ai", "ment", "é", "ö", "ñ", "la", "mo", "ka", "su", "ta", "вод", "но", "文", "章"]


class _Writer:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, of: list):
        return of[int(self.rng.integers(len(of)))]

    def words(self, n: int) -> str:
        return " ".join("".join(self.pick(_SYLLABLES) for _ in range(int(self.rng.integers(1, 5)))) for _ in range(n))

    def sentence(self) -> str:
        s = self.words(int(self.rng.integers(1, 4)) if self.chance(0.2) else int(self.rng.integers(2, 18))).capitalize()
        if self.chance(0.1):
            s = s.replace(" ", self.pick(["!! ", " | ", "&amp;&amp; ", "### ", " &copy; "]))
        return s + self.pick([".", ".", ".", ".", "?", "!", ""])

    def prose(self, most: int = 6) -> str:
        if self.chance(0.12):  # a word or two alone
            return self.words(int(self.rng.integers(1, 3))).capitalize() + self.pick([".", ".", "", "!"])
        return " ".join(self.sentence() for _ in range(int(self.rng.integers(1, most + 1))))

    def named(self, part: str, tag: str = "div", inside: str = "") -> str:
        how = self.rng.random()
        name = self.pick(NAMES[part])
        extra = f" {self.pick(NAMES['wrap'])}" if self.chance(0.2) else ""
        attribute = f' class="{name}{extra}"' if how < 0.65 else f' id="{name}"' if how < 0.9 else f" class='{name}-{self.rng.integers(99)}'"
        return f"<{tag}{attribute}>{inside}</{tag}>"

    def links(self, part: str) -> str:
        n = int(self.rng.integers(2, 11))
        text = lambda: self.pick(SAYINGS[part]) if self.chance(0.35) and part in SAYINGS else self.words(int(self.rng.integers(1, 5)))
        each = [f'<a href="/{i}">{text()}</a>' for i in range(n)]
        if self.chance(0.7):
            return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>"
        return self.pick([" ", " | ", ""]).join(each) if self.chance(0.6) else "".join(f"<div>{x}</div>" for x in each)

    def nav(self) -> str:
        return f"<nav>{self.links('nav')}</nav>" if self.chance(0.6) else self.named("nav", self.pick(["div", "ul", "div"]), self.links("nav"))

    def header(self) -> str:
        inside = "".join(x for x, p in ((f'<a href="/">{self.words(2)}</a>', 0.5), (f"<p>{self.sentence()}</p>", 0.5), (f"<h1>{self.words(3)}</h1>", 0.15), (f"<div>{self.words(3)}</div>", 0.3), (self.nav(), 0.4), (self.form(), 0.2)) if self.chance(p))
        return f"<header>{inside}</header>" if self.chance(0.6) else self.named("header", "div", inside)

    def saying(self, part: str) -> str:
        said = self.pick(SAYINGS[part]) if self.chance(0.4) else self.prose(2)
        return self.pick([f"<p>{said}</p>", said, f"<span>{said}</span>", f"<h3>{self.words(2)}</h3><p>{said}</p>", f"<p>{said}</p><button>OK</button>"])

    def small(self, part: str) -> str:
        return self.named(part, self.pick(["div", "div", "section", "aside" if part in ("ad", "side") else "div", "p"]), self.saying(part))

    def form(self) -> str:
        fields = "".join(f"<label>{self.pick(SAYINGS['form']) if self.chance(0.5) else self.words(2)}</label><input name=x>" for _ in range(int(self.rng.integers(1, 5))))
        options = "<select>" + "".join(f"<option>{self.words(1)}</option>" for _ in range(3)) + "</select>" if self.chance(0.2) else ""
        inside = (f"<p>{self.sentence()}</p>" if self.chance(0.4) else "") + fields + options + f"<button>{self.words(1)}</button>"
        return f"<form>{inside}</form>" if self.chance(0.7) else self.named("form", "form", inside)

    def side(self) -> str:
        inside = "".join(f"<h{self.rng.integers(2, 5)}>{self.pick(SAYINGS['side']) if self.chance(0.5) else self.words(2)}</h3>" + (self.links("side") if self.chance(0.6) else f"<p>{self.prose(3)}</p>") for _ in range(int(self.rng.integers(1, 4))))
        return self.pick([f"<aside>{inside}</aside>", self.named("side", "aside", inside), self.named("side", "div", inside), self.named("side", "section", inside)])

    def comments(self) -> str:
        each = []
        for _ in range(int(self.rng.integers(1, 7))):
            who = self.pick([f"<span>{self.words(1)}</span>", f"<h4>{self.words(2)}</h4>", f"<div>{self.words(2)}</div>", f"<b>{self.words(1)}</b>", ""])
            said = f"<p>{self.prose(4)}</p>" if self.chance(0.8) else self.prose(4)
            each.append(self.pick([self.named("comments", "div", who + said), self.named("comments", "li", who + said), f"<div>{who}{said}</div>", f"<article>{who}{said}</article>", f"<li>{who}{said}</li>"]))
        head = f"<h3>{self.pick(SAYINGS['comments'])}</h3>" if self.chance(0.6) else ""
        return self.named("comments", self.pick(["div", "section", "ol", "ul"]), head + "".join(each) + (self.form() if self.chance(0.3) else ""))

    def footer(self) -> str:
        said = f"&copy; {self.words(2)} &middot; {self.sentence()}" if self.chance(0.5) else self.pick(SAYINGS["footer"])
        inside = self.pick([said, f"<p>{said}</p>", self.links("footer") + f"<p>{said}</p>", f"<div>{self.prose(2)}</div>{said}"])
        return f"<footer>{inside}</footer>" if self.chance(0.6) else self.named("footer", "div", inside)

    def inked(self, text: str) -> str:
        """Article text: marked, with some inline tags."""
        w = text.split(" ")
        if len(w) > 3 and self.chance(0.35):
            i = int(self.rng.integers(len(w) - 1))
            tag = self.pick(["b", "i", "em", "strong", 'a href="/x"', "span", "code"])
            w[i] = f"<{tag}>{w[i]}</{tag.split()[0]}>"
        return MARK + " ".join(w)

    def paragraph(self) -> str:
        text = self.inked(self.prose())
        how = self.rng.random()
        if how < 0.6:
            return f"<p>{text}</p>"
        if how < 0.7:
            return f"<p><b>{text}<br>"
        if how < 0.8:
            return f"<p>{text}"
        return self.pick([f"<blockquote>{text}</blockquote>", f"<div>{text}</div>", f"<p class=x>{text}</p>", f"<h2>{MARK}{self.words(3)}</h2><p>{text}</p>", "<ul>" + "".join(f"<li>{self.inked(self.sentence())}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>", f"<pre>{text}</pre>", "<table><tr>" + "".join(f"<td>{MARK}{self.words(2)}</td>" for _ in range(4)) + "</tr></table>", f"<section><h3>{MARK}{self.words(2)}</h3><p>{text}</p></section>"])

    def article(self) -> str:
        title = self.inked(self.words(int(self.rng.integers(2, 10)))) if self.chance(0.5) else MARK + self.sentence()
        pieces = [f"<h{1 if self.chance(0.85) else 2}>{title}</h1>"] if self.chance(0.9) else []
        n = int(self.rng.integers(1, 5)) if self.chance(0.3) else int(self.rng.integers(2, 26))
        pieces += [self.paragraph() for _ in range(n)]
        for part, p in (("ad", 0.25), ("share", 0.2), ("notice", 0.12)):
            if self.chance(p):
                pieces.insert(int(self.rng.integers(1, len(pieces) + 1)), self.small(part))
        if self.chance(0.12):
            pieces.insert(int(self.rng.integers(1, len(pieces) + 1)), self.pick([self.side(), self.form()]))
        if self.chance(0.12):
            pieces.append(self.comments())
        inside = "".join(pieces)
        how = self.rng.random()
        if how < 0.5:
            return f"<article>{inside}</article>"
        if how < 0.6:
            return f"<main>{inside}</main>"
        if how < 0.85:
            return self.named("content", self.pick(["div", "section", "article", "main"]), inside)
        return f"<div>{inside}</div>" if how < 0.92 else inside

    def page(self) -> str:
        head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{self.words(4)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        before = [x() for x, p in ((self.header, 0.4), (self.nav, 0.75), (lambda: self.small("notice"), 0.3), (lambda: self.small("ad"), 0.45), (self.form, 0.12), (self.side, 0.12)) if self.chance(p)]
        after = [x() for x, p in ((lambda: self.small("share"), 0.2), (lambda: self.small("ad"), 0.25), (self.comments, 0.35), (self.side, 0.35), (self.form, 0.12), (lambda: self.small("notice"), 0.12), (self.footer, 0.8)) if self.chance(p)]
        if self.chance(0.3):
            self.rng.shuffle(before)
        middle = self.article() if self.chance(0.97) else ""
        if self.chance(0.35):
            middle = self.named("wrap", "div", middle + (after.pop(0) if after and self.chance(0.4) else ""))
        page = head + "<!-- x -->".join(before) + middle + "".join(after)
        return page + "</body></html>" if self.chance(0.85) else page


def labelled_page(rng: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """The blocks of a generated page and which of them are article text."""
    parsed = blocks(_Writer(rng).page())
    labels = [MARK in b.text for b in parsed]
    return [Block(b.text.replace(MARK, "").strip() or "x", b.path, b.linked) for b in parsed], labels
