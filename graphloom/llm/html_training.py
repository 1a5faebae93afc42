"""Generated pages with known main content, for fitting and testing the extraction of HTML. Content blocks carry the attribute ``data-gold``, which features never see."""

from __future__ import annotations

import numpy as np

_SYLLABLES = "ka lo mi ren tas vor del sun pra ni ost ber gal the wen dri mo ul sha fe cor ban tin ya".split()
_CONTENT = (
    "content article-body post entry-content main-text story page-body text post-content article prose markdown-body hentry richtext post__body article__content td-post-content main-column single-post news-text "
    "body-copy story-body blog-entry field-body wiki-content reader longform chapter recipe-steps lesson documentation"
).split()
_JUNK = {
    "nav": "nav menu navbar main-menu breadcrumbs topnav masthead toolbar pagination pager dropdown navigation site-header mega-menu tabs language-switch skip-links".split(),
    "ad": "ad ads banner sponsored promo advert adsense ad-slot adbox advertisement sponsor dfp-unit promobox leaderboard outbrain taboola affiliate paid-links".split(),
    "side": "sidebar widget related aside-box recommended tags tag-cloud trending popular recent-posts most-read rail secondary more-stories see-also archives author-bio".split(),
    "foot": "footer copyright site-footer bottom legal colophon disclaimer imprint credits terms".split(),
    "talk": "comments comment-list respond share social newsletter comments-area disqus sharing share-bar subscribe signup cookie-notice consent popup modal login-box rating poll".split(),
}


class Writer:
    """Random pages from a seed."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def words(self, n: int) -> str:
        r = self.r
        out = []
        for k in range(n):
            w = "".join(_SYLLABLES[i] for i in r.integers(0, len(_SYLLABLES), r.integers(1, 4)))
            out.append(w.capitalize() if k == 0 or r.random() < 0.05 else w)
            if k < n - 1 and r.random() < 0.1:
                out[-1] += "," if r.random() < 0.6 else "."
        return " ".join(out)

    def attr(self, names: list[str]) -> str:
        r = self.r
        if r.random() < 0.25:
            return ""
        return f' {"class" if r.random() < 0.75 else "id"}="{names[r.integers(len(names))]}{" box" if r.random() < 0.2 else ""}"'

    def links(self, n: int, item: str = "li") -> str:
        body = "".join(f'<{item}><a href="/{k}">{self.words(int(self.r.integers(1, 4)))}</a></{item}>' for k in range(n))
        return f"<ul>{body}</ul>" if item == "li" else body

    def content(self) -> str:
        r, out = self.r, []
        gold = " data-gold"
        if r.random() < 0.8:
            out.append(f"<h1{gold}>{self.words(int(r.integers(3, 10)))}</h1>")
        for _ in range(int(r.geometric(0.12))):
            kind = r.random()
            n = int(r.geometric(0.03)) if r.random() < 0.75 else int(r.integers(1, 5))
            if kind < 0.72:
                text = self.words(n) + "."
                if r.random() < 0.2:
                    text = f"<b>{self.words(4)}</b><br>" + text
                if r.random() < 0.2:
                    text += f' <a href="/x">{self.words(2)}</a> {self.words(6)}.'
                out.append(f"<p{gold}>{text}" + ("</p>" if r.random() < 0.9 else ""))
            elif kind < 0.8:
                out.append(f"<h2{gold}>{self.words(int(r.integers(2, 7)))}</h2>")
            elif kind < 0.88:
                out.append(f"<ul{gold}>" + "".join(f"<li{gold}>{self.words(int(r.integers(3, 20)))}</li>" for _ in range(int(r.integers(2, 6)))) + "</ul>")
            elif kind < 0.93:
                out.append(f"<blockquote{gold}>{self.words(n)}</blockquote>")
            elif kind < 0.97:
                out.append(f"<table{gold}>" + "".join(f"<tr{gold}><td{gold}>{self.words(2)}</td><td{gold}>{self.words(3)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.98:
                out.append(f"<pre{gold}>{self.words(n)}</pre>")
            else:
                out.append(f"<div{gold}>{self.words(n)}. {self.junk(('ad', 'talk')[int(r.integers(2))])} {self.words(int(r.integers(4, 30)))}.</div>")
        if r.random() < 0.15:  # text and adverts in one block, no paragraphs
            out = [self.words(int(r.integers(20, 80))) + "." + (self.junk("ad") if r.random() < 0.6 else "<br><br>") + self.words(int(r.integers(10, 60))) + "." for _ in range(int(r.integers(1, 4)))]
        tag = ("article", "main", "div", "section")[int(r.choice(4, p=[0.35, 0.15, 0.4, 0.1]))]
        return f"<{tag}{gold}{self.attr(_CONTENT)}>{''.join(out)}</{tag}>"

    def junk(self, kind: str) -> str:
        r = self.r
        names = _JUNK[kind]
        if kind == "nav":
            tag = "nav" if r.random() < 0.6 else "div"
            return f"<{tag}{self.attr(names)}>{self.links(int(r.integers(3, 12)), 'li' if r.random() < 0.7 else 'span')}</{tag}>"
        if kind == "ad":
            text = f"{self.words(int(r.integers(3, 25)))}{'.' if r.random() < 0.5 else ''}"
            return f"<div{self.attr(names)}>{f'<p>{text}</p>' if r.random() < 0.3 else text}</div>"
        if kind == "side":
            tag = "aside" if r.random() < 0.5 else "div"
            return f"<{tag}{self.attr(names)}><h3>{self.words(2)}</h3>{self.links(int(r.integers(2, 8)))}<p>{self.words(int(r.integers(2, 15)))}</p></{tag}>"
        if kind == "foot":
            tag = "footer" if r.random() < 0.7 else "div"
            text = f"&copy; {self.words(2)} &middot; {self.words(int(r.integers(2, 20)))}"
            return f"<{tag}{self.attr(names)}>{f'<p>{text}</p>' if r.random() < 0.5 else text}{self.links(int(r.integers(0, 5)), 'span')}</{tag}>"
        return f"<div{self.attr(names)}><h4>{self.words(2)}</h4>" + "".join(f"<div{self.attr(['comment', 'reply'])}><a href='/u'>{self.words(1)}</a> {f'<p>{self.words(int(r.integers(2, 25)))}</p>' if r.random() < 0.4 else self.words(int(r.integers(2, 25)))}</div>" for _ in range(int(r.integers(0, 5)))) + "</div>"

    def page(self) -> str:
        r = self.r
        head = f"<!DOCTYPE html><html><head><title>{self.words(5)}</title><style>p{{margin:0}}</style><script>if(a<b)document.write('<p>no</p>')</script></head><body>"
        before = [k for k in ("nav", "ad", "side", "nav") if r.random() < 0.5]
        after = [k for k in ("ad", "side", "talk", "side", "ad") if r.random() < 0.4]
        middle = self.content()
        if r.random() < 0.3:
            middle = f"<div class='wrap'>{self.junk('ad')}{middle}{self.junk('side')}</div>"
        end = self.junk("foot") if r.random() < 0.85 else ""
        return head + "".join(map(self.junk, before)) + middle + "".join(map(self.junk, after)) + end + "</body></html>"


def pages(n: int, seed: int) -> list[str]:
    """n generated pages."""
    w = Writer(seed)
    return [w.page() for _ in range(n)]
