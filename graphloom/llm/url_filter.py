"""URL filter: logistic regression on hashed character n-grams of host and path.

The model is fitted on a small labelled URL table that is kept here; callers may pass their own. A URL is lower-cased; its host loses ``www.`` and the port, its path ends before ``?`` and ``#``.
All n-grams of ``GRAMS`` bytes of ``^host$`` and of ``^path$`` are hashed, apart from each other, into 2 ** BITS features; a URL's features are scaled by the square root of their number.
Scoring is one pass of array operations over the url column; html is never read.

Defined results: page_id is an integer, or a string of one (others fail in the cast); null and empty URLs, and those without a host, have a null score and are not kept; repeated rows are scored each; a score that equals the threshold is rejected; an
empty table gives no rows. Columns besides page_id and url are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as K

BITS, GRAMS, THRESHOLD = 18, (3, 4, 5), 0.5
#: Weight of the square penalty, steps of the fit, and the share of URLs that are taken to be unwanted beforehand.
PENALTY, STEPS, UNWANTED = 0.02, 300, 0.4
U64 = np.uint64

_BAD = {
    "gambling": "casino slots poker roulette blackjack betting bets jackpot bingo lottery gamble wager bookmaker sportsbook".split(),
    "pills": "pills viagra cialis pharmacy meds tramadol xanax steroids slimming dietpills rxdrugs".split(),
    "adult": "adult porn xxx sex nude escorts camgirls erotic hentai milf hookup fetish".split(),
    "money": "loans payday cash bitcoin-doubler forex-signals getrich earnmoney giveaway freegift prize iphone-winner voucher".split(),
    "fakes": "replica knockoff cheap discount-bags fakewatches outlet-sale essay-writer fake-id".split(),
    "ads": "ads adserver adclick adtrack tracker tracking pixel popunder banners clickbait affiliate adnetwork telemetry".split(),
    "malice": "crack keygen warez serials torrents malware phishing verify-account secure-login free-download spam spammer bulkmail backlinks linkfarm seo-links".split(),
}
_FILL = "best top online vip mega super hot free win now club world zone 24 365 king pro x my the go easy real royal live".split()
_PLAIN_WORDS = (
    "garden history museum school river music travel kitchen recipe science physics library letters journal mountain weather harbor village forest bridge painter theatre orchestra language grammar poem novel "
    "stories essays notes archive review research college church market farm bakery coffee bicycle railway ocean island astronomy geology biology medicine nursing hospital clinic therapist analysis address "
    "additive shadow ladder reader advice adventure advent advisor adapt badge canadian trackside racetrack soundtrack clicker winter window twin winery sussex essex middlesex unisex sextant expert pillow pillar caterpillar "
    "spoke poke bettina better alphabet tibet sherbet cashmere cashew loaned freedom carefree freeway spelling winged cracker firecracker nutcracker proper shopping workshop bishop worship buyer verified "
    "teacher student student-union parents council court parliament election report gazette tribune herald chronicle courier times daily evening morning press radio weekly monthly "
    "track tracks field lane stadium athletics chess football rugby tennis rowing sailing hiking climbing camping fishing knitting pottery woodwork sewing quilting gardening beekeeping birds trees flowers bread cheese soup honey apple pear plum"
).split()
_KNOWN = (
    "wikipedia.org britannica.com archive.org gutenberg.org python.org apache.org kernel.org mozilla.org debian.org nature.com science.org arxiv.org nasa.gov noaa.gov who.int un.org europa.eu bbc.co.uk "
    "theguardian.com lemonde.fr spiegel.de elpais.com zeit.de reuters.com apnews.com stanford.edu mit.edu ox.ac.uk github.com stackoverflow.com medium.com wordpress.org w3.org ietf.org postgresql.org"
).split()
_ENDS = "com net org info co.uk de fr es io biz eu example.com example.net example.org".split()
_SUB = "www. m. blog. en. news. shop. app. old. go. static.".split()
_BAD_PATHS = "/bonus/spin /free/claim /buy/cheap /click?id=3 /track/hit /offer.html /promo/now /register?aff=9 /slots/play /order/pills /track/pixel.gif /ads/banner.js /login/verify.php /download/crack.exe /xxx/video /win/prize /cams/live /pixel?u=1 /out.php?to=ad".split()
_GOOD_PATHS = "/wiki/History /articles/spring.html /about /docs/tutorial.html /books/chapter-3 /news/local /blog/my-garden /recipes/bread /papers/1706.03762 /science/physics /travel/notes /contact /privacy /people/anna-smith /events/2019 /research/projects /archive/1998/may".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table: (url, 1 for unwanted), about 2,500 rows.

    Unwanted hosts are made of a word of a kind of unwanted site and another word, the others of two ordinary words, many of which hold an unwanted word's letters; both take the
    same endings, subdomains and numbered paths, so that these tell nothing. Each host also comes with a path of its class, and paths of unwanted sites are on ordinary hosts, too.
    """
    r = np.random.default_rng(3)
    pick = lambda x: x[int(r.integers(len(x)))]

    def neutral() -> str:
        return ("/", f"/{int(r.integers(1, 9999))}", f"/{pick(['en', 'de', 'fr', 'es', 'a', 'p'])}/{int(r.integers(1, 9999))}{pick(['', '/', '.html', '?page=2'])}", f"/20{int(r.integers(10, 25))}/{int(r.integers(1, 13)):02d}/{pick(['', 'index.html', 'page'])}", "/index.php")[int(r.integers(5))]

    def host(words: list[str]) -> str:
        return f"{pick(_SUB) if r.random() < 0.4 else ''}{pick(['-', '-', '', '.']).join(words)}{int(r.integers(1, 99)) if r.random() < 0.08 else ''}.{pick(_ENDS)}"

    out = []
    for kind in _BAD.values():
        for word in kind:
            for _ in range(7):
                second = pick(kind) if r.random() < 0.35 else pick(_FILL) if r.random() < 0.7 else pick(_PLAIN_WORDS)
                words = [word, second] if r.random() < 0.6 else [second, word]
                h = host(words if r.random() < 0.9 else [word])
                out.append((f"http{pick(['', 's'])}://{h}{neutral()}", 1))
                if r.random() < 0.5:
                    out.append((f"http://{h}{pick(_BAD_PATHS)}", 1))
    for word in _PLAIN_WORDS:
        for _ in range(5):
            second = pick(_PLAIN_WORDS) if r.random() < 0.8 else pick(_FILL)
            words = [word, second] if r.random() < 0.5 else [second, word]
            h = host(words if r.random() < 0.75 else [word])
            out.append((f"http{pick(['', 's'])}://{h}{neutral()}", 0))
            if r.random() < 0.4:
                out.append((f"http://{h}{pick(_GOOD_PATHS)}", 0))
    for _ in range(120):  # invented names, which tell nothing
        h = host(["".join(pick("aeiou") if (k + turn) % 2 else pick("bcdfghklmnprstvwz") for k in range(int(r.integers(4, 10)))) for turn in range(int(r.integers(1, 3)))])
        out.append((f"https://{h}{neutral()}", 0))
    for h in _KNOWN:
        out += [(f"https://{pick(_SUB) if r.random() < 0.5 else ''}{h}{neutral() if r.random() < 0.5 else pick(_GOOD_PATHS)}", 0) for _ in range(4)]
        if r.random() < 0.3:
            out.append((f"https://{h}{pick(_BAD_PATHS)}", 0))
    return out


_URL = re.compile(rb"^\s*(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@\s]*@)?(?:www\.)?([^/?#:\s]+)(?::\d*)?([^?#]*)", re.S)


def split(url: bytes) -> tuple[bytes, bytes]:
    """Host and path of a URL in lower case; an empty host if there is none."""
    m = _URL.match(url.lower())
    return (m[1], m[2].strip()) if m else (b"", b"")


def features(urls: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed features of all URLs in a row, bounds of each URL's, whether it has a host)."""
    parts = [split(u) for u in urls]
    there = np.array([bool(h) for h, _ in parts], bool)
    flat = b"".join(b"^" + h + b"$" + b"^" + p + b"$" for h, p in parts)
    size = np.array([[len(h) + 2, len(p) + 2] for h, p in parts], np.int64).reshape(-1)
    off = np.concatenate(([0], np.cumsum(size)))
    b = np.frombuffer(flat, np.uint8).astype(U64)
    side = np.repeat(np.arange(len(size)) % 2, size).astype(U64)
    left = np.repeat(off[1:], size) - np.arange(len(b))
    got, owner = [], []
    for n in GRAMS:
        if len(b) >= n:
            h = np.zeros(len(b) - n + 1, U64)
            for k in range(n):
                h = h * U64(257) + b[k : len(b) - n + 1 + k]
            at = np.flatnonzero(left[: len(h)] >= n)
            got.append((K.mix(h[at] * U64(8) + side[at] + U64(2 * n)) >> U64(64 - BITS)).astype(np.int64))
            owner.append(np.searchsorted(off, at, "right") - 1)
    feature = np.concatenate(got) if got else np.empty(0, np.int64)
    who = np.concatenate(owner) // 2 if owner else np.empty(0, np.int64)
    order = np.argsort(who, kind="stable")
    return feature[order], np.searchsorted(who[order], np.arange(len(parts) + 1)), there


class Model:
    """Weights and bias; ``score`` is the probability that a URL is unwanted."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.w, self.bias = np.zeros(1 << BITS, np.float32), 0.0
        y = np.array([r[1] for r in rows], float)
        if not len(y) or y.min() == y.max():
            self.bias = -30.0 if not len(y) or y[0] == 0 else 30.0
            return
        f, ptr, _ = features(r[0].encode() for r in rows)
        used, col = np.unique(f, return_inverse=True)
        many = np.diff(ptr)
        row = np.repeat(np.arange(len(y)), many)
        scale = (1 / np.sqrt(np.maximum(many, 1)))[row]  # the matrix is sparse: a feature of a row counts so often as it is there
        w, bias = np.zeros(len(used)), 0.0
        weight = np.where(y == 1, UNWANTED / y.sum(), (1 - UNWANTED) / (len(y) - y.sum()))
        # accelerated gradient steps; features are of unit length, so that 1 is a safe step for the loss scaled by 4
        v, vb = w.copy(), bias
        for t in range(STEPS):
            p = 1 / (1 + np.exp(-(np.bincount(row, v[col] * scale, len(y)) + vb)))
            g = weight * (p - y)
            nw, nb = v - 3.0 * (np.bincount(col, g[row] * scale, len(used)) + PENALTY / len(y) * v), vb - 3.0 * g.sum()
            k = t / (t + 3)
            v, vb = nw + k * (nw - w), nb + k * (nb - bias)
            w, bias = nw, nb
        self.w[used], self.bias = w, float(bias)

    def score(self, urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, and whether there is a host to judge."""
        f, ptr, there = features(urls)
        c = np.concatenate(([0.0], np.cumsum(self.w[f], dtype=np.float64)))
        z = (c[ptr[1:]] - c[ptr[:-1]]) / np.sqrt(np.maximum(np.diff(ptr), 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500))), there


def filter_urls(pages: DataFrame, rows: list[tuple[str, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, host, score, keep) of every page."""
    model = Model(labelled_urls() if rows is None else rows)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            urls = [(u or "").encode() for u in b.column(1).to_pylist()]
            p, there = m.score(urls) if urls else (np.empty(0), np.empty(0, bool))
            hosts = [split(u)[0].decode("utf-8", "replace") or None for u in urls]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hosts, pa.string()), pa.array(p, pa.float64(), mask=~there), pa.array(there & (p < threshold))], names=["page_id", "url", "host", "score", "keep"])

    d = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url")
    return d.mapInArrow(run, "page_id long, url string, host string, score double, keep boolean")
