"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: the text between two borders of block elements. A block's features are its
ancestors' tags, the words of their class, id and role, and shapes of the text (length, share of it in links,
end mark, place). The field labels each block main or other; it is trained by gradient ascent of the
conditional likelihood (forward-backward, AdaGrad) on labelled pages, and decoded by Viterbi. As no labelled
pages are at hand, they are made by ``labelled_pages``: a seeded generator of page layouts whose every block is
known to be main text or not.

Scripts, styles, titles, comments and other text that no browser shows in the page are not blocks; nor is what stands in an element
with the ``hidden`` attribute or the style ``display: none``. Character
references are decoded in each text node, white space inside a block (also a line break element, and U+00A0 and other blanks of Unicode) becomes one space, blocks are
joined by a line feed. A null page is empty; a page without a block has an empty text. Repeated rows and rows without an id are extracted like
others; an empty table gives an empty one; other columns are not read. A page is read as a whole, whatever its length.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sarnai.llm.common import map_columns

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
UNSEEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)(?!\s*=\s*[\"']?until-found)|\bstyle\s*=\s*(?:\"[^\"]*|'[^']*|[^\s>\"']*)display\s*:\s*none", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN_TEXT = frozenset(["script", "style", "title", "noscript", "template", "textarea", "iframe", "svg", "noframes", "head"])
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())  # other tags end it
RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in HIDDEN_TEXT - {"head"}}
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot "
    "th thead tr ul".split()
)
CLOSES = {  # an opening tag closes these when they are innermost
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
WIDTH = 1 << 14
MAIN = 1
PAGES, EPOCHS, RATE, RIDGE = 420, 6, 0.25, 1e-4


@dataclass
class Block:
    text: str
    ancestors: tuple[tuple[str, str], ...]  # tag; its class, id and role
    linked: int  # characters of it in links


def _veiled(veil: list[str], tag: str, closing: bool, rest: str) -> bool:
    """Follow a tag inside an element that is not shown; false if it ends the element from outside and counts itself."""
    if closing:
        if tag not in veil:
            veil.clear()
            return False
        while veil.pop() != tag:
            pass
        return True
    if veil == ["p"] and tag in BLOCK or len(veil) == 1 and veil[0] in CLOSES.get(tag, ()):
        veil.clear()
        return False
    if not rest.endswith("/"):
        veil.append(tag)
    return True


def leaf_blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    pieces: list[tuple[str, bool]] = []
    link = False
    veil: list[str] = []  # open elements from one that is not shown
    at = hidden = 0

    def close() -> None:
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                out.append(Block(text, tuple(stack), sum(len(p) for p, in_link in pieces if in_link)))
            pieces.clear()

    def add(text: str) -> None:
        nonlocal hidden
        if hidden and text.strip():  # no text can stand in the head itself
            hidden = 0
        if text and not hidden and not veil:
            pieces.append((html.unescape(text), link))

    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "head":
            hidden = 0 if closing else 1
        elif tag not in IN_HEAD and (not closing or tag == "body"):
            hidden = 0
        if tag in RAW_END:
            if not closing and not m[3].endswith("/"):
                end = RAW_END[tag].search(page, at)
                at = end.start() if end else len(page)
        elif veil and (tag in VOID or _veiled(veil, tag, closing, m[3])):
            continue
        elif not closing and tag not in VOID and m[3] and UNSEEN.search(m[3]):
            veil.append(tag)
            if tag in BLOCK:
                close()
        elif tag == "a":
            link = not closing
        elif tag == "br":
            add(" ")
        elif tag in BLOCK:
            close()
            if closing:
                link = False
                if any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
            else:
                while stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(tag, ())):
                    stack.pop()
                if tag != "hr":
                    names = " ".join(filter(None, sum(ATTRIBUTE.findall(m[3]), ()))) if m[3] else ""
                    stack.append((tag, names))
    add(page[at:])
    close()
    return out


@lru_cache(1 << 15)
def _number(name: str) -> int:
    return zlib.crc32(name.encode()) % WIDTH


@lru_cache(1 << 15)
def _words(names: str) -> tuple[str, ...]:
    """Words of class, id and role: camel case and punctuation split, plurals cut."""
    found = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower())
    return tuple(w[:-1] if len(w) > 3 and w.endswith("s") else w for w in found)


@lru_cache(1 << 12)
def _ancestor_features(ancestors: tuple[tuple[str, str], ...]) -> tuple[int, ...]:
    names = {"bias"}
    for depth, (tag, words) in enumerate(reversed(ancestors)):
        if tag in ("html", "body"):
            continue
        names.add(f"in {tag}")
        if depth < 2:
            names.add(f"at {depth} {tag}")
        names.update(f"is {w}" for w in _words(words))
    inner = [t for t, _ in ancestors if t not in ("html", "body")]
    names.add(f"depth {min(len(inner), 6)}")
    return tuple(sorted(set(map(_number, names))))


def features(blocks: list[Block]) -> list[np.ndarray]:
    out = []
    for i, b in enumerate(blocks):
        n = len(b.text)
        share = b.linked / n
        names = (
            f"size {n.bit_length()}", f"words {min((b.text.count(' ') + 1).bit_length(), 7)}", f"linked {0 if share < 0.1 else 1 if share < 0.6 else 2}",
            f"end {b.text[-1] in '.?!…»”'}", f"mark {'©' in b.text or '(c)' in b.text}", f"place {min(9, 10 * i // len(blocks))}", f"from end {min(len(blocks) - 1 - i, 3)}",
        )
        out.append(np.array([*_ancestor_features(b.ancestors), *map(_number, names)], np.int32))
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # (2, WIDTH)
    steps: np.ndarray  # (2, 2) from, to
    first: np.ndarray  # (2,)


def _scores(model: Model, rows: list[np.ndarray]) -> np.ndarray:
    return np.array([model.weights[:, r].sum(1) for r in rows])


def viterbi(model: Model, scores: np.ndarray) -> list[int]:
    best, back = model.first + scores[0], []
    for s in scores[1:]:
        ways = best[:, None] + model.steps
        back.append(ways.argmax(0))
        best = ways.max(0) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _marginals(model: Model, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of labels (n, 2) and of neighbours summed (2, 2), by forward-backward in logarithms."""
    n = len(scores)
    f, b = np.zeros((n, 2)), np.zeros((n, 2))
    f[0] = model.first + scores[0]
    for i in range(1, n):
        f[i] = np.logaddexp(f[i - 1, 0] + model.steps[0], f[i - 1, 1] + model.steps[1]) + scores[i]
    for i in range(n - 2, -1, -1):
        x = scores[i + 1] + b[i + 1]
        b[i] = np.logaddexp(model.steps[:, 0] + x[0], model.steps[:, 1] + x[1])
    z = np.logaddexp(*f[-1])
    one = np.exp(f + b - z)
    two = np.exp(f[:-1, :, None] + model.steps[None] + (scores[1:] + b[1:])[:, None, :] - z).sum(0)
    return one, two


def train(pages: list[tuple[list[Block], list[int]]]) -> Model:
    model = Model(np.zeros((2, WIDTH)), np.zeros((2, 2)), np.zeros(2))
    past = Model(np.full((2, WIDTH), 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6))
    data = [(features(b), np.array(y)) for b, y in pages if b]
    rng = np.random.default_rng(3)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            rows, y = data[k]
            one, two = _marginals(model, _scores(model, rows))
            want = np.eye(2)[y]
            gap = want - one
            at = np.concatenate(rows)
            per = np.repeat(gap, [len(r) for r in rows], axis=0)
            touched, where = np.unique(at, return_inverse=True)
            g = np.zeros((len(touched), 2))
            np.add.at(g, where, per)
            g = g.T - RIDGE * model.weights[:, touched]
            past.weights[:, touched] += g * g
            model.weights[:, touched] += RATE * g / np.sqrt(past.weights[:, touched])
            steps = -two
            np.add.at(steps, (y[:-1], y[1:]), 1)
            for value, old, grad in ((model.steps, past.steps, steps), (model.first, past.first, gap[0])):
                old += grad * grad
                value += RATE * grad / np.sqrt(old)
    return model


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(page, its main blocks in order). Text is random syllables, so that only layout and shapes teach."""
    rng = np.random.default_rng(seed)
    syllables = "an be ca de er fo gi hu in ja ko le mi no ou pa qui ra st ti un ve wo xa ye zo ción heit ment ö é".split()
    pick = lambda *options: options[rng.integers(len(options))]
    chance = lambda p: rng.random() < p

    def word() -> str:
        w = "".join(syllables[i] for i in rng.integers(0, len(syllables), rng.integers(1, 4)))
        return w + pick("%%%", "&amp;&amp;", "***", "!!", "###") if odd and chance(0.6) else w

    def text(low: int, high: int, end: str = ".") -> str:
        ws = [word() for _ in range(rng.integers(low, high + 1))]
        return (" ".join(ws)).capitalize() + end

    def words(low: int, high: int) -> str:
        return text(low, high, "")

    def nav() -> str:
        items = "".join(f'<li><a href="/{i}">{words(1, 2)}</a></li>' for i in range(rng.integers(2, 9)))
        return pick(
            f"<nav><ul>{items}</ul></nav>", f'<nav class="{pick("main-nav", "navbar", "top")}"><ul>{items}</ul></nav>', f'<div class="{pick("menu", "nav", "navigation", "breadcrumbs", "topbar")}"><ul>{items}</ul></div>',
            f'<ul id="{pick("menu", "nav", "main-menu")}">{items}</ul>', f'<header><h2>{words(1, 3)}</h2><nav><ul>{items}</ul></nav></header>', f'<div role="navigation"><ul>{items}</ul></div>',
        )

    def advert() -> str:
        body = pick(text(3, 30), words(2, 6), f'<a href="x">{words(2, 8)}</a>', f"<p>{text(4, 30)}</p>")
        return f'<{(t := pick("div", "div", "section", "aside"))} class="{pick("ad", "ads", "advert", "advertisement", "ad-slot", "banner", "sponsored", "promo", "ad-banner")}">{body}</{t}>'

    def notice() -> str:
        return f'<div {pick("class", "id")}="{pick("cookie", "cookie-notice", "consent", "notice", "gdpr", "alert", "popup", "newsletter", "subscribe", "paywall")}"><p>{text(4, 30)}</p><button>{words(1, 2)}</button></div>'

    def form() -> str:
        return f'<form action="/s"><label>{words(1, 4)}</label><input name="q"><select><option>{words(1, 1)}</option><option>{words(1, 1)}</option></select><p>{text(3, 12)}</p><button>{words(1, 2)}</button></form>'

    def share() -> str:
        links = " ".join(f'<a href="#">{words(1, 1)}</a>' for _ in range(3))
        return f'<div class="{pick("share", "social", "tags", "meta", "byline", "author", "toolbar")}">{pick(links, words(1, 4))}</div>'

    def side() -> str:
        items = "".join(f'<li><a href="x">{words(2, 8)}</a></li>' for _ in range(rng.integers(1, 6)))
        body = pick(f"<h3>{words(1, 3)}</h3><ul>{items}</ul>", f"<p>{text(5, 40)}</p>", f"<h3>{words(1, 3)}</h3><p>{text(5, 40)}</p>")
        return pick(f"<aside>{body}</aside>", f'<aside class="{pick("sidebar", "widget")}">{body}</aside>', f'<div {pick("class", "id")}="{pick("sidebar", "related", "widget", "recommended", "side", "rail", "trending")}">{body}</div>')

    def reader_comments() -> str:
        each = lambda: pick(f"<p>{text(2, 60)}</p>", f'<span class="user">{words(1, 2)}</span><p>{text(2, 60)}</p>', text(2, 40))
        inside = "".join(f'<{(t := pick("div", "li", "article"))} class="comment">{each()}</{t}>' for _ in range(rng.integers(1, 6)))
        return f'<{(t := pick("section", "div"))} {pick("class", "id")}="{pick("comments", "comments", "comment-list", "discussion", "responses", "disqus", "replies")}"><h2>{words(1, 3)}</h2>{inside}</{t}>'

    def footer() -> str:
        body = pick(f"&copy; {words(1, 3)} &middot; {text(2, 12)}", f"<p>{text(3, 20)}</p>", f"<ul><li><a>{words(1, 2)}</a></li><li><a>{words(1, 2)}</a></li></ul><p>&copy; {words(1, 3)}</p>")
        return pick(f"<footer>{body}</footer>", f"<footer>{body}</footer>", f'<div {pick("class", "id")}="{pick("footer", "site-footer", "copyright", "legal")}">{body}</div>')

    def main() -> tuple[str, list[str]]:
        kept: list[str] = []

        def own(s: str) -> str:
            kept.append(" ".join(html.unescape(re.sub(r"<[^>]*>", " ", s)).split()))
            return s

        parts = [f"<h1>{own(words(1, 14))}</h1>"] if chance(0.9) else []
        if chance(0.3):
            parts.append(share())
        for _ in range(rng.integers(1, 12)):
            kind = rng.random()
            if kind < 0.6:
                parts.append(f"<p>{own(text(1, pick(4, 20, 120), pick('.', '.', '.', '?', '')))}{pick('</p>', '</p>', '')}")
            elif kind < 0.68:
                parts.append(f"<p><b>{own(text(1, 8, pick('', '.')))}<br>")
            elif kind < 0.76:
                parts.append(f"<{(t := pick('h2', 'h3', 'h4'))}>{own(words(1, 8))}</{t}>")
            elif kind < 0.84:
                parts.append("<ul>" + "".join(f"<li>{own(text(1, 15, pick('', '.')))}</li>" for _ in range(rng.integers(1, 5))) + "</ul>")
            elif kind < 0.88:
                parts.append(f"<blockquote><p>{own(text(3, 40))}</p></blockquote>")
            elif kind < 0.91:
                parts.append("<table><tr>" + "".join(f"<td>{own(words(1, 4))}</td>" for _ in range(rng.integers(1, 5))) + "</tr></table>")
            elif kind < 0.93:
                parts.append(f"<pre>{own(words(2, 12))}</pre>")
            elif kind < 0.95:
                parts.append(f"<figure><img src=x><figcaption>{own(text(2, 12))}</figcaption></figure>")
            else:
                parts.append(pick(advert, share, form, notice, side)())
        if chance(0.15):
            parts.append(reader_comments())
        body = "".join(parts)
        kind = rng.random()
        if kind < 0.5:
            return f"<article>{body}</article>", kept
        if kind < 0.62:
            return f"<main>{body}</main>", kept
        if kind < 0.72:
            return f"<main><article class='{pick('post', 'entry', 'story')}'>{body}</article></main>", kept
        if kind < 0.95:
            return f'<div {pick("class", "id")}="{pick("content", "post", "entry", "article", "article-body", "main", "main-content", "story", "text", "post-body")}">{body}</div>', kept
        return f"<div>{body}</div>", kept

    pages = []
    for k in range(n):
        odd = k % 5 == 0
        body, kept = main()
        before = [f() for f, p in ((nav, 0.75), (advert, 0.4), (notice, 0.25), (form, 0.1), (share, 0.1)) if chance(p)]
        after = [f() for f, p in ((side, 0.35), (reader_comments, 0.3), (advert, 0.2), (form, 0.15), (notice, 0.1), (footer, 0.95)) if chance(p)]
        if chance(0.15):
            before.append(side())
        if chance(0.2):  # an article with nothing before it, nothing after it, or neither
            before = []
        if chance(0.2):
            after = []
        page = f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><script>var t='</p>';</script></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"
        pages.append((page, kept))
    return pages


def labels_of(blocks: list[Block], kept: list[str]) -> list[int]:
    """1 for the blocks that are the main ones, matched in order."""
    out, at = [], 0
    for b in blocks:
        hit = at < len(kept) and b.text == kept[at]
        at += hit
        out.append(int(hit))
    return out


@lru_cache(1)
def default_model() -> Model:
    """Trained once per driver on the generated pages; a few seconds."""
    pages = []
    for page, kept in labelled_pages():
        blocks = leaf_blocks(page)
        pages.append((blocks, labels_of(blocks, kept)))
    return train(pages)


def main_text(model: Model, page: str) -> str:
    blocks = leaf_blocks(page)
    if not blocks:
        return ""
    labels = viterbi(model, _scores(model, features(blocks)))
    return "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y == MAIN)


def extract_main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    model = model or default_model()

    def make():
        def step(ids, urls, pages_):
            texts = [main_text(model, p or "") for p in pages_.to_pylist()]
            return {"page_id": ids, "url": urls, "text": pa.array(texts, pa.string()), "n_chars": list(map(len, texts))}

        return step

    return map_columns(pages, ["page_id", "url", "html"], make, "page_id long, url string, text string, n_chars long")
