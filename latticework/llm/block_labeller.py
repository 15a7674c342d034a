"""A bidirectional LSTM in numpy that labels every leaf block of a page as main text or not.

A block's vector holds its hashed tag path (element names, and class, id and
role names, each also with its height above the block), hashed words, and a few
figures.  The network reads the whole sequence of a page's blocks both ways, so
each label depends on all of them.  It is trained here, from made-up pages of
many layouts with a fixed seed; the same seed gives the same network.
"""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from latticework.llm.html_blocks import Block, parse

PATH_BITS, WORD_BITS = 8, 5
FIGURES = 10
WIDTH = (1 << PATH_BITS) + (1 << WORD_BITS) + FIGURES
HIDDEN = 20
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


@lru_cache(maxsize=100_000)
def word_place(word: str) -> int:
    return (1 << PATH_BITS) + (zlib.crc32(word.lower().encode()) & ((1 << WORD_BITS) - 1))


@lru_cache(maxsize=100_000)
def path_places(path: tuple) -> tuple[int, ...]:
    """Features of a tag path: each name, and each name of the lowest three elements with its height."""
    mask, out = (1 << PATH_BITS) - 1, set()
    for height, (tag, names) in enumerate(reversed(path)):
        for n in (tag, *(f".{x}" for x in names)):
            out.add(zlib.crc32(n.encode()) & mask)
            if height < 3:
                out.add(zlib.crc32(f"{height}{n}".encode()) & mask)
    return tuple(out)


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """One row for each block of all pages."""
    n = sum(map(len, pages))
    out = np.zeros((n, WIDTH), np.float32)
    base, i = WIDTH - FIGURES, 0
    for blocks in pages:
        for k, b in enumerate(blocks):
            row = out[i]
            i += 1
            row[list(path_places(b.path))] = 1.0
            words = b.text.split(" ")
            np.add.at(row, [word_place(w) for w in words], 1.0 / len(words))
            size = len(b.text)
            row[base:] = (
                1.0,
                np.log1p(len(words)) / 5,
                b.link_chars / size,
                sum(map(b.text.count, ".,;!?")) / len(words),
                b.text[-1] in ".!?:\"'”»…",
                b.path[-1][0] in HEADINGS if b.path else 0.0,
                k / len(blocks),
                1.0 / len(blocks),
                b.text[0].isupper(),
                min(sum(map(b.text.count, "©|»›•")), 3) / 3,
            )
    return out


@dataclass
class Labeller:
    """Weights: for each direction, input, recurrent and bias (gates in, forget, out, candidate); then the read-out."""

    weights: dict[str, np.ndarray]

    def states(self, x: np.ndarray, live: np.ndarray, way: str, keep: bool = False):
        """Hidden states over padded sequences x of shape (time, page, feature)."""
        w, u, b = (self.weights[f"{n}{way}"] for n in "wub")
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        pre, memory = x @ w + b, []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ u
            g = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            a = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            m = live[t][:, None]
            c_new = f * c + i * a
            tc = np.tanh(c_new)
            if keep:
                memory.append((t, h, c, i, f, o, a, tc))
            c, h = np.where(m, c_new, c), np.where(m, o * tc, h)
            out[t] = h
        return out, memory

    def scores(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        both = np.concatenate((self.states(x, live, "f")[0], self.states(x, live, "b")[0]), 2)
        return (both @ self.weights["v"] + self.weights["d"])[:, :, 0]

    def label(self, pages: list[list[Block]]) -> list[list[bool]]:
        """Whether each block is main text; pages of like length run together."""
        out: list[list[bool]] = [[] for _ in pages]
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            group = [order[at]]
            at += 1
            while at < len(order) and len(group) < 128 and (len(group) + 1) * len(pages[order[at]]) <= 8192:
                group.append(order[at])
                at += 1
            x, live, _ = padded([pages[i] for i in group], None)
            good = self.scores(x, live) > 0
            for k, i in enumerate(group):
                out[i] = good[: len(pages[i]), k].tolist()
        return out


def padded(pages: list[list[Block]], labels: list[list[int]] | None):
    steps = max(map(len, pages))
    x, live, y = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), bool), np.zeros((steps, len(pages)), np.float32)
    rows, i = vectors(pages), 0
    for k, p in enumerate(pages):
        x[: len(p), k], live[: len(p), k] = rows[i : i + len(p)], True
        if labels is not None:
            y[: len(p), k] = labels[k]
        i += len(p)
    return x, live, y


def fresh(seed: int) -> Labeller:
    rng, w = np.random.default_rng(seed), {}
    for way in "fb":
        w[f"w{way}"] = (rng.standard_normal((WIDTH, 4 * HIDDEN)) * 0.15).astype(np.float32)
        w[f"u{way}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)
        w[f"b{way}"] = np.zeros(4 * HIDDEN, np.float32)
        w[f"b{way}"][HIDDEN : 2 * HIDDEN] = 1.0
    w["v"] = (rng.standard_normal((2 * HIDDEN, 1)) * 0.2).astype(np.float32)
    w["d"] = np.zeros(1, np.float32)
    return Labeller(w)


def gradients(net: Labeller, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy, by backpropagation through time both ways."""
    runs = {way: net.states(x, live, way, keep=True) for way in "fb"}
    both = np.concatenate((runs["f"][0], runs["b"][0]), 2)
    s = (both @ net.weights["v"] + net.weights["d"])[:, :, 0]
    ds = np.where(live, 1 / (1 + np.exp(-np.clip(s, -30, 30))) - y, 0).astype(np.float32) / max(live.sum(), 1)
    grads = {"v": np.einsum("tph,tp->h", both, ds)[:, None], "d": ds.sum(keepdims=True).reshape(1)}
    for k, way in enumerate("fb"):
        w, u = net.weights[f"w{way}"], net.weights[f"u{way}"]
        dv = net.weights["v"][k * HIDDEN : (k + 1) * HIDDEN, 0]
        dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
        dz, du = np.zeros((x.shape[0], x.shape[1], 4 * HIDDEN), np.float32), np.zeros_like(u)
        for t, h, c, i, f, o, a, tc in reversed(runs[way][1]):
            m = live[t][:, None]
            dht = np.where(m, dh + ds[t][:, None] * dv, 0)
            dct = np.where(m, dc, 0) + dht * o * (1 - tc**2)
            z = np.concatenate((dct * a * i * (1 - i), dct * c * f * (1 - f), dht * tc * o * (1 - o), dct * i * (1 - a**2)), 1)
            dz[t] = z
            du += h.T @ z
            dh = np.where(m, z @ u.T, dh)
            dc = np.where(m, dct * f, dc)
        flat = dz.reshape(-1, 4 * HIDDEN)
        grads |= {f"w{way}": x.reshape(-1, WIDTH).T @ flat, f"u{way}": du, f"b{way}": flat.sum(0)}
        assert w.shape == grads[f"w{way}"].shape
    return grads


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = 5, batch: int = 48, rate: float = 0.01, seed: int = 11) -> Labeller:
    net = fresh(seed)
    order, rng, step = list(range(len(pages))), random.Random(seed), 0
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    s = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            group = [pages[i] for i in order[at : at + batch]]
            x, live, y = padded([p for p, _ in group], [l_ for _, l_ in group])
            step += 1
            for k, g in gradients(net, x, live, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g**2
                net.weights[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
    return net


class PageMaker:
    """Made-up pages whose blocks are marked: main text carries a mark that is taken off again."""

    MARK = "\ue000"
    CONTENT = ("content", "post", "entry", "story", "article-body", "main-content", "post-body", "text", "page-content", "entry-content")
    ASIDE = ("sidebar", "side", "related", "widget", "recommended", "more-stories", "trending", "popular")
    ADS = ("ad", "ads", "advert", "banner", "sponsor", "promo", "ad-slot", "advertisement")
    NOTICE = ("cookie", "notice", "consent", "alert", "gdpr", "cookie-banner", "message", "paywall")
    MENU = ("menu", "nav", "navigation", "breadcrumb", "topbar", "links", "navbar", "pagination", "tags")
    FORM = ("newsletter", "subscribe", "login", "search", "signup", "contact-form")
    SHARE = ("share", "social", "follow", "share-buttons")
    COMMENT = ("comments", "comment-list", "discussion", "responses", "disqus", "reader-comments", "replies")
    HEAD = ("header", "masthead", "site-header", "top", "logo", "hero")
    TITLE = ("post-title", "entry-title", "title", "headline")
    FOOT = ("footer", "site-footer", "bottom", "copyright", "legal", "colophon")
    NOISE = ("row", "col", "container", "wrapper", "inner", "grid", "box", "x1", "clearfix", "module", "block", "section")

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        syllables = "an er on re th en in ti ou ha st le que de la el ar os ci ment sch ung ver ein tion es at ed nd is or te co do ra ö é ñ ü ê".split()
        self.words = ["".join(self.r.choices(syllables, k=self.r.choice((1, 1, 2, 2, 3, 4)))) for _ in range(1500)]

    def sentence(self, low: int, high: int) -> str:
        w = self.r.choices(self.words, k=self.r.randint(low, high))
        if self.r.random() < 0.08:
            w = [x + self.r.choice(("***", "$$$", "%%%", "&amp;", "!!", "")) for x in w]
        return w[0].capitalize() + " " + " ".join(w[1:]) + self.r.choice((".", ".", ".", "!", "?", ""))

    def prose(self) -> str:
        return " ".join(self.sentence(1, 18) for _ in range(self.r.choice((1, 1, 2, 3, 5, 8))))

    def cls(self, names: tuple[str, ...]) -> str:
        k = [self.r.choice(names)] + ([self.r.choice(self.NOISE)] if self.r.random() < 0.3 else [])
        return f' {self.r.choice(("class", "class", "id"))}="{" ".join(k)}"'

    def noise(self) -> str:
        return f' class="{self.r.choice(self.NOISE)}"' if self.r.random() < 0.5 else ""

    def items(self, low: int, high: int) -> str:
        r = self.r
        one = lambda: f'<a href="/{r.choice(self.words)}">{self.sentence(1, r.choice((1, 1, 2, 8)))}</a>'
        if r.random() < 0.75:
            return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(r.randint(low, high))) + "</ul>"
        return r.choice((" | ", " ", "<br>")).join(one() for _ in range(r.randint(low, high)))

    def menu(self) -> str:
        body = self.items(2, 9)
        return f"<nav{self.noise()}>{body}</nav>" if self.r.random() < 0.6 else f"<div{self.cls(self.MENU)}>{body}</div>"

    def header(self) -> str:
        body = self.r.choice((f"<a href='/'>{self.sentence(1, 4)}</a>", f"<p>{self.sentence(1, 8)}</p>", f"<div>{self.sentence(1, 5)}</div>" + self.menu(), f"<h1>{self.sentence(1, 4)}</h1>", f"<h2>{self.sentence(1, 4)}</h2>{self.menu()}"))
        return f"<header{self.noise()}>{body}</header>" if self.r.random() < 0.5 else f"<div{self.cls(self.HEAD)}>{body}</div>"

    def footer(self) -> str:
        r = self.r
        body = r.choice(("&copy; ", "", "Copyright ", "© 2024 ")) + r.choice((f"{r.choice(self.words)}.example.com &middot; {self.prose()}", self.sentence(2, 9), f"<p>{self.prose()}</p>" + self.items(2, 6), self.items(2, 5)))
        shut = "" if r.random() < 0.1 else "</footer>"
        return f"<footer{self.noise()}>{body}{shut}" if r.random() < 0.65 else f"<div{self.cls(self.FOOT)}>{body}</div>"

    def aside(self) -> str:
        r = self.r
        body = f"<h3>{self.sentence(1, 4)}</h3>" + r.choice((self.items(2, 6), f"<p>{self.prose()}</p>", f"<p>{self.sentence(3, 12)}</p>" + self.items(1, 4)))
        return f"<aside{self.noise()}>{body}</aside>" if r.random() < 0.5 else f"<div{self.cls(self.ASIDE)}>{body}</div>"

    def ad(self) -> str:
        body = self.r.choice((self.prose(), f"<p>{self.prose()}</p>", f"<a href='http://{self.r.choice(self.words)}.test'>{self.sentence(3, 9)}</a>"))
        return f"<{(t := self.r.choice(('div', 'div', 'section', 'aside')))}{self.cls(self.ADS)}>{body}</{t}>"

    def notice(self) -> str:
        return f"<div{self.cls(self.NOTICE)}>{self.r.choice(('', '<p>'))}{self.prose()} {self.r.choice(('', '<button>OK</button>', '<a href=#>Accept</a>'))}</div>"

    def form(self) -> str:
        body = f"<label>{self.sentence(1, 4)}</label><input><button>{self.sentence(1, 2)}</button>" + self.r.choice(("", f"<p>{self.prose()}</p>", "<select><option>A</option><option>B</option></select>"))
        return f"<form{self.cls(self.FORM) if self.r.random() < 0.5 else ''}>{body}</form>" if self.r.random() < 0.8 else f"<div{self.cls(self.FORM)}>{body}</div>"

    def comments(self) -> str:
        one = lambda: self.r.choice((f'<li class="comment"><p>{self.prose()}</p></li>', f'<div class="comment"><b>{self.sentence(1, 2)}</b><p>{self.prose()}</p></div>', f'<article class="comment"><p>{self.prose()}</p></article>'))
        return f"<{(t := self.r.choice(('div', 'section', 'div', 'ol')))}{self.cls(self.COMMENT)}><h3>{self.sentence(1, 3)}</h3>{''.join(one() for _ in range(self.r.randint(1, 5)))}</{t}>"

    def share(self) -> str:
        return f"<div{self.cls(self.SHARE)}>{self.items(2, 5)}</div>"

    def main(self) -> str:
        r, M = self.r, self.MARK
        head = f"<h1>{M}{self.sentence(2, 12)}</h1>" if r.random() < 0.85 else f"<h2{self.cls(self.TITLE)}>{M}{self.sentence(2, 12)}</h2>"
        if r.random() < 0.15:
            head = f"<header>{head}</header>"
        out = [head if r.random() < 0.9 else ""]
        for _ in range(r.choice((0, 1, 2, 3, 5, 8, 12))):
            k = r.random()
            if k < 0.62:
                out.append(f"<p>{M}{self.prose()}</p>")
            elif k < 0.72:
                out.append(f"<p><b>{M}{self.prose()}<br>")
            elif k < 0.79:
                out.append(f"<{(t := r.choice(('h2', 'h3')))}>{M}{self.sentence(1, 7)}</{t}>")
            elif k < 0.84:
                out.append("<ul>" + "".join(f"<li>{M}{self.sentence(2, 14)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.87:
                out.append(f"<blockquote>{r.choice(('', '<p>'))}{M}{self.prose()}</blockquote>")
            elif k < 0.89:
                out.append(f"<pre>{M}{self.prose()}</pre>")
            elif k < 0.91:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{M}{self.sentence(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif k < 0.93:
                out.append(f"<p>{M}{self.prose()} <a href='/{r.choice(self.words)}'>{self.sentence(1, 4)}</a> {self.sentence(2, 9)}</p>")
            elif k < 0.95:
                out.append(f"<div>{M}{self.prose()}</div>")
            else:
                out.append(r.choice((self.ad, self.share, self.aside, self.form))())
        return "".join(out)

    def page(self) -> tuple[list[Block], list[int]]:
        r = self.r
        before = [f for f, p in ((self.header, 0.5), (self.menu, 0.75), (self.notice, 0.2), (self.ad, 0.45), (self.form, 0.12), (self.aside, 0.15)) if r.random() < p]
        after = [f for f, p in ((self.share, 0.15), (self.comments, 0.3), (self.aside, 0.25), (self.ad, 0.2), (self.form, 0.15), (self.menu, 0.1)) if r.random() < p]
        r.shuffle(after)
        if r.random() < 0.3:
            r.shuffle(before)
        body = self.main()
        k = r.random()
        if k < 0.45:
            body = f"<article{self.noise()}>{body}</article>"
        elif k < 0.6:
            body = f"<main{self.noise()}>{body}</main>"
        elif k < 0.9:
            body = f"<{(t := r.choice(('div', 'div', 'section')))}{self.cls(self.CONTENT)}>{body}</{t}>"
        elif k < 0.95:
            body = f"<table><tr><td>{body}</td></tr></table>"
        for _ in range(r.choice((0, 0, 1, 2))):
            body = f"<{(t := r.choice(('div', 'main', 'div', 'section')))}{self.noise()}>{body}</{t}>"
        if r.random() < 0.03:
            return self.marked(self.old_page())
        html = "".join(f() for f in before) + body + "".join(f() for f in after)
        if r.random() < 0.85:
            html += self.footer()
        return self.marked(html)

    def old_page(self) -> str:
        """A page laid out as a table: links above or beside the text, a line in small print below."""
        r = self.r
        links = r.choice((" | ", " ", "<br>", " - ")).join(f'<a href="/{r.choice(self.words)}">{self.sentence(1, 2)}</a>' for _ in range(r.randint(2, 7)))
        cell, text = f"<td bgcolor=#ccc>{links}</td>", f"<td>{self.main()}</td>"
        top = f"<tr>{cell}</tr><tr>{text}</tr>" if r.random() < 0.6 else f"<tr>{cell}{text}</tr>"
        small = r.choice(("", "&copy; ", "Last updated ", "Copyright ")) + self.sentence(2, 9)
        return f"<table width=100%>{top}<tr><td align=center>{r.choice(('<small>', '<font size=1>', ''))}{small}</td></tr></table>"

    def marked(self, html: str) -> tuple[list[Block], list[int]]:
        """Blocks of a page's body, and which of them carry the mark."""
        html = "<html><head><title>t</title></head><body>" + html
        blocks = parse(html + "</body></html>")[0]
        labels = [int(self.MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = " ".join(b.text.replace(self.MARK, "").split()) or "."
        return blocks, labels


PAGES = 1600
SEED = 20240611


@lru_cache(maxsize=1)
def default_labeller() -> Labeller:
    """Trained once in a driver's life."""
    maker = PageMaker(SEED)
    made = [maker.page() for _ in range(PAGES)]
    return train([(b, y) for b, y in made if b])
