"""Labelled pages for the extraction model: written by a rule, with the label of every block."""

from __future__ import annotations

import random

SYLLABLES = "an be co da el fi go hu in ja ke lo mi no or pa qu re so ti un ver wi yo za".split()
# Names that page authors give to what isn't the article, and to what is.
OTHER = {
    "menu": "nav navbar navigation menu main-menu topnav breadcrumb breadcrumbs submenu toc-menu pagination pager".split(),
    "header": "header site-header page-header masthead topbar banner branding logo".split(),
    "footer": "footer site-footer page-footer bottom colophon copyright footer-links".split(),
    "sidebar": "sidebar side-bar aside rail right-column widget widget-area related related-posts recommended trending popular more-stories".split(),
    "notice": "notice cookie cookie-banner cookie-notice consent gdpr alert message popup modal newsletter subscribe subscription paywall warning toast disclaimer".split(),
    "advert": "ad ads advert advertisement ad-slot ad-container sponsored sponsor promo promotion banner-ad adsbox commercial".split(),
    "comments": "comments comment comment-list discussion responses replies reader-comments disqus user-comments respond".split(),
    "form": "form search search-form login signup contact-form feedback".split(),
    "share": "share social social-links sharing share-buttons tags author-box byline-box".split(),
}
CONTENT = "content article post entry main story body text article-body post-content entry-content main-content story-body page-content post-body".split()


#: Names of paragraphs of an article, some with words that other parts are named by.
PLAIN = "text intro lead first byline-text box column page-text top-line main-note item row block col right left story-part widget-text more-text".split()
#: What pages say around an article.
CUES = {
    "header": ["Search", "Skip to content", "Log in"],
    "footer": ["Copyright 2020", "All rights reserved.", "Privacy policy", "Terms of use", "Follow us"],
    "sidebar": ["Related articles", "Recommended", "Most read", "You may also like", "More stories"],
    "notice": ["We use cookies.", "Accept cookies", "Subscribe to our newsletter", "Sign up today"],
    "advert": ["Advertisement", "Sponsored"],
    "comments": ["Comments", "3 comments", "Leave a comment"],
    "share": ["Share this", "Share on", "Follow us"],
}


def labelled_page(seed: int) -> str:
    """A page whose elements carry data-y: 1 for the article's, 0 for others'. Names are left out, or mean nothing, now and then, so that
    the model learns the page's structure as well."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(r.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(f"{words(2, 18).capitalize()}{r.choice(['.', '.', '.', '!', '?'])}" for _ in range(r.randint(a, b)))

    def link() -> str:
        return f'<a href="/{word()}">{words(1, 3)}</a>'

    def el(tag: str, inner: str, y: int, name: str = "") -> str:
        if name and r.random() < 0.12:
            name = r.choice([word(), f"{word()}-{word()}"])
        attribute = f' {r.choice(["class", "class", "id"])}="{name}"' if name else ""
        return f'<{tag}{attribute} data-y="{y}">{inner}</{tag}>'

    def named(kind: str, inner: str, tag: str) -> str:
        """By a telling tag, or by a plain one with a telling name, or both; what it says may tell, too."""
        if kind in CUES and r.random() < 0.4:
            inner = el(r.choice(["p", "div", "h3", "span"]), r.choice(CUES[kind]), 0) + inner
        return el(tag, inner, 0) if tag != "div" and r.random() < 0.5 else el(tag if r.random() < 0.5 else r.choice(["div", "section"]), inner, 0, r.choice(OTHER[kind]))

    def links() -> str:
        return el("ul", "".join(el("li", link(), 0) for _ in range(r.randint(2, 8))), 0)

    def other_text() -> str:
        return el("p", sentences(1, 3) if r.random() < 0.7 else link(), 0) if r.random() < 0.7 else sentences(1, 2)

    def menu() -> str:
        return named("menu", links() if r.random() < 0.8 else " ".join(link() for _ in range(4)), "nav")

    def sidebar() -> str:
        return named("sidebar", el("h3", words(1, 3), 0) + (links() if r.random() < 0.6 else other_text()), "aside")

    def notice() -> str:
        return named("notice", other_text(), "div")

    def advert() -> str:
        return named("advert", other_text(), "div")

    def button() -> str:
        return el("button", words(1, 2), 0, r.choice(["", "btn", word()])) if r.random() < 0.5 else ""

    def choices() -> str:
        return el(r.choice(["select", "select", "datalist"]), "".join(el("option", words(1, 2), 0) for _ in range(r.randint(1, 5))), 0) if r.random() < 0.3 else ""

    def inline(text: str) -> str:
        """A sentence with marked words in it: most are the article's own, some an advert's."""
        x = r.random()
        if x < 0.2:
            mark = el(r.choice(["span", "em", "b", "a", "code", "mark", "small"]), words(1, 4), 1, r.choice([word(), word(), f"{word()}-{word()}", "highlight", "link", "term", "dropcap", "text"]))
        elif x < 0.26:
            kind = r.choice(["advert", "advert", "share", "notice"])
            mark = el(r.choice(["span", "a", "ins"]), r.choice([words(1, 4), *CUES[kind]]), 0, r.choice(OTHER[kind]))
        elif x < 0.29:
            mark = el("button", words(1, 2), 0, r.choice(["", word()]))
        else:
            return text
        at = text.find(" ") + 1
        return f"{text[:at]}{mark} {text[at:]}"

    def form() -> str:
        return el("form", (el("p", sentences(1, 1), 0) if r.random() < 0.5 else "") + f"<label>{words(1, 2)}</label><input>{choices()}{button()}", 0, r.choice(["", *OTHER["form"]]))

    def comments() -> str:
        one = [el(r.choice(["div", "li", "article"]), el("p", sentences(1, 4), 0), 0, r.choice(["comment", "reply", "comment-body", ""])) for _ in range(r.randint(1, 5))]
        return named("comments", el(r.choice(["h2", "h3"]), words(1, 3), 0) + "".join(one) + (form() if r.random() < 0.4 else ""), "div")

    def share() -> str:
        return named("share", " ".join(link() for _ in range(r.randint(2, 5))), "div")

    def content() -> list[str]:
        parts = []
        if r.random() < 0.12:  # many short lines
            line = words(1, 3)
            parts += [el("p", r.choice([f"{line}.", f"{line}.", line, words(1, 4)]), 1) for _ in range(r.randint(4, 40))]
        for _ in range(r.randint(1, 10)):
            x = r.random()
            if x < 0.62:
                text = inline(sentences(1, 6) if r.random() < 0.75 else words(1, 4) + "." if r.random() < 0.6 else words(5, 120))
                parts.append(el("p", f"{text} {link()} {words(2, 9)}." if r.random() < 0.2 else text, 1, r.choice(PLAIN) if r.random() < 0.2 else ""))
            elif x < 0.74:
                parts.append(el(r.choice(["h2", "h3", "h4"]), words(1, 8), 1))
            elif x < 0.84:
                parts.append(el(r.choice(["ul", "ol"]), "".join(el("li", sentences(1, 1) if r.random() < 0.7 else words(1, 5), 1) for _ in range(r.randint(1, 5))), 1))
            elif x < 0.89:
                parts.append(el("blockquote", el("p", sentences(1, 3), 1) if r.random() < 0.5 else sentences(1, 3), 1))
            elif x < 0.92:
                parts.append(el("pre", words(3, 20), 1))
            elif x < 0.96:
                parts.append(el("table", "".join(el("tr", "".join(el("td", words(1, 4), 1) for _ in range(3)), 1) for _ in range(3)), 1))
            else:
                parts.append(el("figure", "<img>" + el("figcaption", sentences(1, 1), 1), 1))
            if r.random() < 0.03:
                parts.append(choices() or button() or el("p", button(), 0))
            if r.random() < 0.08:
                parts.append(r.choice([advert, advert, sidebar, notice, share, form])())
        return parts

    title = el(r.choice(["h1", "h1", "h1", "h2", "h3"]), words(1, 10), 1)
    if r.random() < 0.25:
        title = el("header", title + (el("p", sentences(1, 1), 1) if r.random() < 0.4 else ""), 1)
    inner = title + "".join(content()) + (share() if r.random() < 0.2 else "") + (comments() if r.random() < 0.1 else "")
    style = r.random()
    if style < 0.45:
        body = el("article", inner, 1, r.choice(["", "", *CONTENT]))
    elif style < 0.6:
        body = el("main", inner, 1)
    elif style < 0.9:
        body = el("div", inner, 1, r.choice(CONTENT))
    else:
        body = el("div", el("div", inner, 1, r.choice(["", *CONTENT])), 1)
    if style < 0.3 and r.random() < 0.4:
        body = el(r.choice(["main", "div", "section"]), body, 1, r.choice(["", *CONTENT]))
    before = [f() for f, p in ((lambda: named("header", el(r.choice(["p", "div", "h2"]), words(1, 4), 0) + (menu() if r.random() < 0.4 else ""), "header"), 0.5), (menu, 0.7), (notice, 0.3), (advert, 0.5), (form, 0.2), (sidebar, 0.2)) if r.random() < p]
    after = [f() for f, p in ((comments, 0.4), (sidebar, 0.4), (advert, 0.2), (form, 0.15), (notice, 0.2), (share, 0.1), (lambda: named("footer", other_text() if r.random() < 0.7 else links(), "footer"), 0.85)) if r.random() < p]
    r.shuffle(before)
    middle = before + [body] + after
    if r.random() < 0.25:
        middle = [el("div", "".join(middle), 1, r.choice(["", "wrapper", "page", "container", "site"]))]
    hidden = f'<div style="display:none" data-y="0">{sentences(1, 2)}</div>' if r.random() < 0.15 else ""
    return f'<!DOCTYPE html><html data-y="1"><head><title>{words(2, 6)}</title></head><body data-y="1">{hidden}{"".join(middle)}</body></html>'
