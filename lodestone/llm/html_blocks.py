"""HTML main text by a recurrent block labeller.

A page becomes the sequence of its text blocks: runs of text between block-level tags, without comments, scripts, styles and other unread elements. Each block has a vector: hashed tag path
with class, id and role words, all its words hashed and scaled by the root of their number, length, link share and punctuation. A numpy bidirectional LSTM reads the whole sequence, and a logistic unit labels each block as main text or not, with the
document on both sides as context. The network is trained here, at the first use, on pages drawn from a fixed seed in many layouts with all kinds of elements, and its weights are kept; it sees no page of the input.

Cases: null or empty html, and pages without main text, give an empty string; broken markup (unclosed or stray tags) is read as browsers do, by closing what a new block implies; whole pages are read;
the states run through the whole page, and longer pages run with fewer others at a time, so memory is bounded by the longest page; repeated rows get equal results; other columns pass.
"""

from __future__ import annotations

import hashlib
import html
import inspect
import io
import re
import sys
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._shared import fresh_path, shared_dir, text_slices

# The element names of HTML by how their content is read.
UNREAD = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "select", "textarea", "canvas", "math", "title"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "ruby", "rt"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: A start tag of these closes an open p.
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SELF_CLOSING = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "th", "th": "td", "option": "option"}

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")

PATH, WORDS, NUMBERS, HIDDEN = 96, 32, 7, 20
INPUT = PATH + WORDS + NUMBERS
#: Blocks of a page in a full batch of pages.
WINDOW = 512


@lru_cache(100_000)
def _place(word: str, size: int) -> tuple[int, int]:
    h = zlib.crc32(word.encode())
    return h % size, 1 if h & 0x10000 else -1


def tags(page: str):
    """(begin, end, is an end tag, lower-cased name, attributes) of each tag; comments and declarations have no name. A raw element's content is for the reader to skip, by sending where to go on.

    Time is linear in the page: of marks behind which no tag ends, each is looked at once."""
    last, lost, at = page.rfind(">"), set(), 0
    while (begin := page.find("<", at)) >= 0:
        at, name = begin + 1, _NAME.match(page, begin + 1)
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            end, name = (end + 3 if end >= 0 else len(page)), None
        elif begin > last:  # no tag ends any more
            return
        elif page.startswith(("!", "?"), at):
            end, name = page.find(">", at) + 1, None
        elif name:
            end, seen = name.end(), []
            while True:  # over quoted values to the end
                mark = _SPECIAL.search(page, end)
                if mark is None or mark.start() in lost:
                    end = -1
                    break
                seen.append(mark.start())
                if mark[0] == ">":
                    end = mark.end()
                    break
                end = page.find(mark[0], mark.end()) + 1
                if not end:
                    end = -1
                    break
            if end < 0:
                lost.update(seen)
                continue
        else:
            continue
        word = name[0].lower() if name else ""
        to = yield begin, end, word.startswith("/"), word.lstrip("/"), page[name.end() : end - 1] if name else ""
        at = max(end, to or 0)


class _Open:
    """The open elements, and what is asked of them, kept up as they come and go."""

    def __init__(self):
        self.stack: list[tuple[str, list[str]]] = []
        self.count: Counter[str] = Counter()
        self.unread = 0
        self.path = [0] * PATH

    def push(self, name: str, words: list[str]) -> None:
        self.stack.append((name, words))
        self.count[name] += 1
        self.unread += name in UNREAD
        self._add(words, 1)

    def _add(self, words: list[str], by: int) -> None:
        for w in words:
            k, sign = _place(w, PATH)
            self.path[k] += sign * by

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            name, words = self.stack.pop()
            self.count[name] -= 1
            self.unread -= name in UNREAD
            self._add(words, -1)

    def close(self, *names: str, within: tuple[str, ...] = ()) -> None:
        """Closes the innermost element of these names, and all in it, if it is not outside an element of `within`."""
        if any(self.count[n] for n in names):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in within:
                    return
                if self.stack[k][0] in names:
                    return self.pop_to(k)

    def nearest(self) -> list[str]:
        """The innermost four words of the path."""
        out: list[str] = []
        for _, words in reversed(self.stack):
            out += reversed(words)
            if len(out) >= 4:
                break
        return out[:4]


def blocks(page: str) -> list[tuple[str, np.ndarray, int]]:
    """(text, vector of the tag path with attribute words, characters in links) of each block in page order."""
    out: list[tuple[str, np.ndarray, int]] = []
    parts: list[str] = []
    opened, links = _Open(), 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = [0.7 * x for x in opened.path]
                for word in opened.nearest():
                    k, sign = _place(word, PATH)
                    path[k] += 0.3 * sign
                out.append((text, np.array(path, np.float32), links))
            parts.clear()
        links = 0

    at, found, to = 0, tags(page), None
    while True:
        try:
            begin, end, ends, name, attributes = found.send(to)
        except StopIteration:
            break
        to = None
        if begin > at and not opened.unread:
            parts.append(page[at:begin])
            if opened.count["a"]:
                links += begin - at
        at = end
        if not name:
            continue
        if ends:
            if name in INLINE:
                opened.close(name)
                continue
            flush()
            opened.close(name)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES_P:
                opened.close("p")
            if name in SELF_CLOSING:
                opened.close(name, SELF_CLOSING[name], within=("ul", "ol", "dl", "table", "select"))
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            at = to = page.find(">", close.end()) + 1 or len(page) if close else len(page)
            continue
        words = []
        if name not in INLINE:
            words.append("<" + name)
            for a in _ATTRIBUTE.finditer(attributes):
                key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if key in ("class", "id", "role"):
                    words += _WORD.findall(value)
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                    words.append("hidden!")
        opened.push(name, words)
    if at < len(page) and not opened.unread:
        parts.append(page[at:])
    flush()
    return out


def vectors(found: list[tuple[str, np.ndarray, int]]) -> np.ndarray:
    x = np.zeros((len(found), INPUT), dtype=np.float32)
    for i, (text, path, links) in enumerate(found):
        row = x[i]
        row[:PATH] = path
        words = text.lower().split()
        said = row[PATH : PATH + WORDS]
        for word in words:
            k, sign = _place(word.strip(".,:;!?()"), WORDS)
            said[k] += sign
        said /= max(np.sqrt(len(words)), np.sqrt(said @ said))  # by the root of their number, and to length 1 at most where words repeat
        n = len(text)
        row[-NUMBERS:] = (np.log1p(n) / 6, min(1.0, links / max(1, n)), text.count(".") / max(4, n / 20), i / max(1, len(found) - 1), float(n < 25), float(text[-1] in ".!?"), float("©" in text))
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x: np.ndarray, mask: np.ndarray, w: np.ndarray, keep: bool = False):
    """One direction: x is steps x batch x INPUT; states of masked steps stay as they were."""
    h = c = np.zeros((x.shape[1], HIDDEN), dtype=x.dtype)
    out, cache = np.zeros((len(x), x.shape[1], HIDDEN), dtype=x.dtype), []
    drive = x @ w[:INPUT] + w[-1]
    for t in range(len(x)):
        z = drive[t] + h @ w[INPUT:-1]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new = f * c + i * g
        if keep:
            cache.append((h, c, i, f, o, g, new, m))
        c = m * new + (1 - m) * c
        h = m * o * np.tanh(new) + (1 - m) * h
        out[t] = h
    return out, cache


def _backward(x: np.ndarray, d_out: np.ndarray, cache: list, w: np.ndarray) -> np.ndarray:
    dw = np.zeros_like(w)
    dh = dc = np.zeros((x.shape[1], HIDDEN), dtype=x.dtype)
    for t in range(len(x) - 1, -1, -1):
        h0, c0, i, f, o, g, new, m = cache[t]
        dh = dh + d_out[t]
        th = np.tanh(new)
        dn = m * (dh * o * (1 - th**2) + dc)
        dz = np.hstack([dn * g * i * (1 - i), dn * c0 * f * (1 - f), m * dh * th * o * (1 - o), dn * i * (1 - g**2)])
        dw[:INPUT] += x[t].T @ dz
        dw[INPUT:-1] += h0.T @ dz
        dw[-1] += dz.sum(axis=0)
        dh = (1 - m) * dh + dz @ w[INPUT:-1].T
        dc = (1 - m) * dc + dn * f
    return dw


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, sequences))
    x, mask = np.zeros((n, len(sequences), INPUT), dtype=np.float32), np.zeros((n, len(sequences)), dtype=np.float32)
    for k, s in enumerate(sequences):
        x[: len(s), k], mask[: len(s), k] = s, 1
    return x, mask


def probabilities(model: tuple[np.ndarray, np.ndarray, np.ndarray], sequences: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence the probability of each block to be main text. Sequences of like length run together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(sequences)
    order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
    k = 0
    while k < len(order):
        some = order[k : k + 64]
        # a page of more than WINDOW blocks runs with fewer others, or alone
        while len(some) > 1 and len(some) * len(sequences[some[-1]]) > 64 * WINDOW:
            some = some[: len(some) // 2]
        k += len(some)
        x, mask = _padded([sequences[i] for i in some])
        a = _forward(x, mask, model[0])[0]
        b = _forward(x[::-1], mask[::-1], model[1])[0][::-1]
        p = _sigmoid(np.concatenate([a, b, np.ones((*a.shape[:2], 1), np.float32)], axis=2) @ model[2])
        for j, i in enumerate(some):
            out[i] = p[: len(sequences[i]), j]
    return out


# Words by which layouts name their parts. The lists are training material of this module.
_MAIN = ["content", "post", "entry", "article", "story", "body", "main", "text"]
_NOISE = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "topnav", "links"],
    "header": ["header", "masthead", "banner", "top", "logo"],
    "footer": ["footer", "bottom", "copyright", "legal", "colophon"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "trending", "popular"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo", "banner", "advertisement"],
    "notice": ["cookie", "notice", "consent", "alert", "newsletter", "subscribe", "popup", "modal", "gdpr"],
    "form": ["form", "search", "login", "signup"],
    "comments": ["comments", "comment", "replies", "discussion", "disqus", "responses"],
    "share": ["share", "social", "tags", "meta", "author"],
}
_SAID = {
    "notice": ["We use cookies to improve this site", "Subscribe to our newsletter", "Accept all"],
    "footer": ["© 2024 Example", "All rights reserved", "Privacy policy Terms"],
    "comments": ["Great article thanks", "I do not agree at all", "Reply", "anon wrote 3 days ago"],
    "form": ["Search", "Email", "Send", "Log in"],
    "ad": ["Advertisement", "Buy now and save", "Sponsored"],
    "share": ["Share this", "Tweet", "By the editor"],
}


def _drawn(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page of random words in a random layout, and the texts of its main blocks."""
    style = int(rng.integers(1, 6)) if rng.random() < 0.35 else 0
    syllables = ["an", "er", "th", "on", "re", "ti", "es", "ou", "in", "ha", "lé", "ung", "ción", "ment", "sch", "que", "a", "o", "de", "li"]

    def words(n: int) -> str:
        out = ["".join(rng.choice(syllables, size=rng.integers(1, 5))) for _ in range(n)]
        for k in range(0, n, int(rng.integers(6, 14))):
            out[k] = out[k].capitalize()
            if k:
                out[k - 1] += "."
        if style == 1:
            out = [w + str(rng.choice(["###", "$$$", "%%%", "***"])) for w in out]
        elif style == 2:
            out = [w.upper() + "!!" for w in out]
        elif style == 3:
            return " | ".join(out)
        elif style == 4:
            out = [w if rng.random() < 0.7 else str(rng.integers(10, 10**9)) for w in out]
        elif style == 5:
            out = [out[0]] * n
        return " ".join(out) + str(rng.choice([".", ".", ".", ""]))

    def noise(kind: str) -> str:
        name = str(rng.choice(_NOISE[kind]))
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div") if rng.random() < 0.6 else str(rng.choice(["div", "section", "ul" if kind == "nav" else "div"]))
        mark = f' {rng.choice(["class", "id"])}="{name}"' if tag in ("div", "section", "ul") or rng.random() < 0.5 else ""
        said = _SAID.get(kind, [])
        line = lambda: str(rng.choice(said)) if said and rng.random() < 0.5 else words(int(rng.integers(2, 30 if kind in ("comments", "ad", "aside", "footer", "notice") else 6)))
        if kind == "nav" or kind == "aside" and rng.random() < 0.5:
            inner = "<ul>" * (tag != "ul") + "".join(f'<li><a href="/x">{words(int(rng.integers(1, 4)))}</a></li>' for _ in range(rng.integers(2, 8))) + "</ul>" * (tag != "ul")
        elif kind == "comments":
            inner = ("<h3>Comments</h3>" if rng.random() < 0.5 else "") + "".join(f"<{t}>{line()}</{t}>" for t in [str(rng.choice(["p", "div", "li"]))] * int(rng.integers(1, 5)))
        elif kind == "footer" and rng.random() < 0.6:
            inner = f"&copy; {words(1)} &middot; {words(int(rng.integers(3, 14)))}"
        else:
            inner = "".join(f"<p>{line()}</p>" if rng.random() < 0.6 else line() + " " for _ in range(rng.integers(1, 4)))
        return f"<{tag}{mark}>{inner}</{tag}>"

    main: set[str] = set()

    def text(n: int) -> str:
        t = words(n)
        main.add(t)
        return t

    def short(most: int = 6) -> str:
        return text(int(rng.integers(1, most)))

    def rich() -> str:
        """Tables, lists of definitions, figures, lists of links, code, numbered lists, sections, details."""
        n = int(rng.integers(2, 6))
        kind = int(rng.choice([0, 1, 2, 3, 3, 3, 4, 5, 6, 7, 8]))
        if kind == 0:
            across = int(rng.integers(2, 5))
            head = "<tr>" + "".join(f"<th>{short(4)}</th>" for _ in range(across)) + "</tr>" if rng.random() < 0.7 else ""
            rows = "".join("<tr>" + "".join(f"<td>{short(8)}</td>" for _ in range(across)) + "</tr>" for _ in range(n))
            caption = f"<caption>{short()}</caption>" if rng.random() < 0.3 else ""
            return f"<table>{caption}<thead>{head}</thead><tbody>{rows}</tbody></table>" if rng.random() < 0.5 else f"<table>{caption}{head}{rows}</table>"
        if kind == 1:
            return "<dl>" + "".join(f"<dt>{short()}</dt><dd>{short(25)}</dd>" for _ in range(n)) + "</dl>"
        if kind == 2:
            return f'<figure><img src="/i.png"><figcaption>{short(15)}</figcaption></figure>' * (1 if rng.random() < 0.8 else 2)
        if kind == 3:
            name = str(rng.choice(["ul", "ol"]))
            return f"<{name}>" + "".join(f'<li><a href="/{k}">{short(9)}</a></li>' for k in range(n)) + f"</{name}>"
        if kind == 4:
            code = "\n".join(short(8) for _ in range(n))
            main.add(" ".join(code.split()))
            return f"<pre><code>{code}</code></pre>" if rng.random() < 0.5 else f"<pre>{code}</pre>"
        if kind == 5:
            return "<ol>" + "".join(f"<li>{short(20)}</li>" for _ in range(n)) + "</ol>"
        if kind == 6:
            return f"<section><h3>{short(7)}</h3><p>{short(60)}</p><h4>{short(7)}</h4><div>{short(30)}</div></section>"
        if kind == 7:
            return f"<details><summary>{short(7)}</summary><p>{short(30)}</p></details>"
        return "".join(f'<p><a href="/{k}">{short(9)}</a></p>' if rng.random() < 0.5 else f"<p><em>{short(9)}</em></p>" for k in range(n))

    inside = []
    if rng.random() < 0.8:
        inside.append(f"<h1>{text(int(rng.integers(3, 12)))}</h1>")
    for _ in range(rng.integers(1, 9)):
        r = rng.random()
        if r < 0.72:
            inside.append(f"<p>{text(int(rng.integers(1, 90)))}</p>")
        elif r < 0.8:
            inside.append(f"<p><b>{text(int(rng.integers(3, 60)))}<br>")
        elif r < 0.86:
            inside.append(f"<h2>{text(int(rng.integers(1, 8)))}</h2>")
        elif r < 0.92:
            inside.append("<ul>" + "".join(f"<li>{text(int(rng.integers(3, 20)))}</li>" for _ in range(rng.integers(2, 5))) + "</ul>")
        else:
            inside.append(f"<blockquote>{text(int(rng.integers(5, 40)))}</blockquote>")
    if rng.random() < 0.6:  # the rest of what articles hold, anywhere in them
        for _ in range(rng.integers(1, 4)):
            inside.insert(int(rng.integers(0, len(inside) + 1)), rich())
    if rng.random() < 0.2:  # short blocks that repeat are still main text
        inside += [f"<p>{text(int(rng.integers(1, 5)))}</p>"] * int(rng.integers(3, 25))
    if rng.random() < 0.3:
        inside.insert(int(rng.integers(0, len(inside) + 1)), noise(str(rng.choice(["ad", "share", "notice", "aside"]))))
    if rng.random() < 0.15:
        inside.append(noise("comments"))
    kind = rng.random()
    name = str(rng.choice(_MAIN))
    open_, close = ("<article>", "</article>") if kind < 0.45 else ("<main>", "</main>") if kind < 0.6 else (f'<div class="{name}">', "</div>") if kind < 0.73 else (f'<div id="{name}">', "</div>") if kind < 0.82 else ("<div>", "</div>")
    before = [noise(str(k)) for k in rng.choice(["nav", "header", "ad", "notice", "form", "aside"], size=rng.integers(0, 4))]
    after = [noise(str(k)) for k in rng.choice(["footer", "comments", "aside", "ad", "share", "form", "notice", "nav"], size=rng.integers(0, 4))]
    return "<html><body>" + "".join(before) + open_ + "".join(inside) + close + "".join(after) + "</body></html>", main


@lru_cache(1)
def train(pages: int = 3000, epochs: int = 6, seed: int = 20240504) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weights of both directions and of the logistic unit, by Adam on drawn pages."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        page, main = _drawn(rng)
        found = blocks(page)
        if found:
            data.append((vectors(found), np.array([t in main for t, _, _ in found], dtype=np.float32)))
    data.sort(key=lambda d: len(d[0]))
    batches = [data[k : k + 32] for k in range(0, len(data), 32)]
    weights = [rng.normal(0, 0.15, (INPUT + HIDDEN + 1, 4 * HIDDEN)).astype(np.float32) for _ in range(2)] + [rng.normal(0, 0.1, 2 * HIDDEN + 1).astype(np.float32)]
    for w in weights[:2]:
        w[-1] = 0
        w[-1, HIDDEN : 2 * HIDDEN] = 1
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            x, mask = _padded([d[0] for d in batches[k]])
            y = np.zeros_like(mask)
            for j, d in enumerate(batches[k]):
                y[: len(d[1]), j] = d[1]
            a, ca = _forward(x, mask, weights[0], True)
            b, cb = _forward(x[::-1], mask[::-1], weights[1], True)
            joined = np.concatenate([a, b[::-1], np.ones((*a.shape[:2], 1), np.float32)], axis=2)
            d = (_sigmoid(joined @ weights[2]) - y) * mask / mask.sum()
            dj = d[:, :, None] * weights[2]
            grads = [_backward(x, dj[:, :, :HIDDEN], ca, weights[0]), _backward(x[::-1], dj[::-1, :, HIDDEN:-1], cb, weights[1]), np.einsum("tb,tbh->h", d, joined)]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - (0.012 if epoch < epochs - 2 else 0.003) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(w.astype(np.float32) for w in weights)


def weights(spark: SparkSession) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """train()'s weights, kept in the shared folder under the digest of this module, so that they are trained once for all sessions that share it."""
    path = f"{shared_dir(spark)}/lodestone/html-weights-{hashlib.sha256(inspect.getsource(sys.modules[__name__]).encode()).hexdigest()[:32]}"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(conf).exists(at):
        packed = io.BytesIO()
        np.savez(packed, *train())
        building = fresh_path(spark, "html-weights")
        spark.createDataFrame([(bytearray(packed.getvalue()),)], "weights binary").coalesce(1).write.parquet(building)
        at.getFileSystem(conf).rename(jvm.org.apache.hadoop.fs.Path(building), at)  # of two sessions the first one's stay
    with np.load(io.BytesIO(bytes(spark.read.parquet(path).first()[0]))) as kept:
        return tuple(kept[name] for name in kept.files)


def main_texts(model, pages: list[str]) -> list[str]:
    """The main text of each page."""
    found = [blocks(p) for p in pages]
    kept = [(p >= 0.5).tolist() for p in probabilities(model, [vectors(f) for f in found])]
    return ["\n\n".join(t for (t, _, _), k in zip(f, keep, strict=True) if k) for f, keep in zip(found, kept, strict=True)]


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """pages without html, with `text` (of other columns of that name, this one stays) beside."""
    shared = pages.sparkSession.sparkContext.broadcast(weights(pages.sparkSession))  # a few hundred KB
    names = [c for c in pages.columns if c not in (html_column, "text")]

    def run(batches):
        for batch in batches:
            for part, _, _ in text_slices(batch, html_column):
                texts = main_texts(shared.value, [p or "" for p in part.column(len(names)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(texts, pa.string())], [*names, "text"])

    kept = pages.select(*[f"`{c}`" for c in names], f"`{html_column}`")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}text string")
