"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read into leaf blocks, stretches of text between the borders of block elements. A block's
features are bits: its ancestors' tags, words in their class and id, its own tag, and its text's
length, links and ending. The field has two labels (text, other), a weight for each bit and label,
and weights for neighbouring labels. It is trained by gradient ascent on labelled pages, which are
generated from templates here (no table of labelled pages exists), and decoded by Viterbi."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import ship

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']+|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Elements whose content is no text of the page.
RAW = frozenset("script style template noscript title textarea iframe svg object canvas audio video xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button label".split()
)
#: A start tag of the key ends an open element of these, up to the nearest of the barriers.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("ul ol dl table body html div article section main aside nav form select".split())
CLOSES_P = BLOCK - {"body", "html", "head", "option", "button", "label", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}

#: Words of class, id and role, by what they tell.
HINTS = {
    "ads": "ad ads advert advertisement adsense advertising sponsor sponsored promo promotion banner adbox adslot",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs topbar skip",
    "side": "sidebar side aside widget rail related recommended recommendations more trending popular teaser",
    "note": "cookie cookies consent gdpr notice notification alert newsletter subscribe signup popup modal overlay paywall disclaimer announcement",
    "talk": "comment comments commentlist reply replies discussion respond disqus responses reviews feedback",
    "share": "share sharing social follow likes",
    "foot": "footer foot copyright legal colophon bottom",
    "head": "header masthead logo site-header branding top",
    "form": "form login search contact input",
    "meta": "meta byline author date tags category categories timestamp",
    "body": "content article post entry story text body main article-body post-content entry-content articlebody prose",
}
_hint = {word: name for name, words in HINTS.items() for word in words.split()}
TAGS = "nav header footer aside form article main section table ul ol li dl blockquote figure figcaption pre h1 h2 h3 p div td th a button select label dialog details head".split()

BITS: dict[str, int] = {}
for _name in (
    *(f"in_{t}" for t in TAGS), *(f"hint_{h}" for h in HINTS), "hidden", *(f"own_{t}" for t in TAGS),
    *(f"words_{n}" for n in (1, 3, 8, 20, 50)), "links_none", "links_some", "links_most", "stop", "comma", "sign", "bias",
    "article_header", "article_aside", "after_h1",
):
    BITS[_name] = 1 << len(BITS)
_in = {t: BITS[f"in_{t}"] for t in TAGS}
_own = {t: BITS[f"own_{t}"] for t in TAGS}

_attributes: dict[tuple[str, str], int] = {}


def element_bits(tag: str, attributes: str) -> int:
    """The bits an element gives to what it holds."""
    key = (tag, attributes)
    known = _attributes.get(key)
    if known is not None:
        return known
    bits = _in.get(tag, 0)
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            for word in re.split(r"[\s_]+", value.lower()):
                for part in (word, *re.split(r"[-]+|(?<=[a-z])\d+$", word)):
                    if part in _hint:
                        bits |= BITS[f"hint_{_hint[part]}"]
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) or (name == "aria-hidden" and value == "true"):
            bits |= BITS["hidden"]
    if len(_attributes) > 50_000:
        _attributes.clear()
    _attributes[key] = bits
    return bits


def text_bits(text: str, linked: int) -> int:
    n = text.count(" ") + 1
    bits = BITS["bias"]
    for least in (1, 3, 8, 20, 50):
        if n >= least:
            bits |= BITS[f"words_{least}"]
    share = linked / len(text)
    bits |= BITS["links_none"] if not linked else BITS["links_most"] if share > 0.6 else BITS["links_some"]
    if text[-1] in ".!?…:;\"'”»)":
        bits |= BITS["stop"]
    if ", " in text:
        bits |= BITS["comma"]
    if text[0] in "©®" or "©" in text[:40]:
        bits |= BITS["sign"]
    return bits


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, bits) of the page's leaf blocks with text, in page order."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = [("", 0)]
    held: list[str] = []
    linked, at, open_links, seen_h1 = 0, 0, 0, False

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                bits = stack[-1][1] | text_bits(text, linked)
                for tag, _ in reversed(stack):
                    if tag in BLOCK:
                        bits |= _own.get(tag, 0)
                        break
                if bits & _in["article"]:
                    bits |= BITS["article_header"] if bits & _in["header"] else 0
                    bits |= BITS["article_aside"] if bits & _in["aside"] else 0
                if seen_h1:
                    bits |= BITS["after_h1"]
                out.append((text, bits))
            held.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal open_links
        for tag, _ in stack[k:]:
            open_links -= tag == "a"
        del stack[k:]

    def add(text: str) -> None:
        nonlocal linked
        if text:
            held.append(text)
            if open_links:
                linked += len(text)

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            elif tag == "br":
                held.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in BLOCK:
                        break
            if tag in CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in CLOSES[tag]:
                        close(k)
                        break
                    if stack[k][0] in BARRIER:
                        break
            seen_h1 = seen_h1 or tag == "h1"
        open_links += tag == "a"
        stack.append((tag, stack[-1][1] | element_bits(tag, m[3] or m[6] or "")))
    flush()
    return out


# -- the field --------------------------------------------------------------------------------


def matrix(bits: list[int]) -> np.ndarray:
    return np.array([[b >> k & 1 for k in range(len(BITS))] for b in bits], dtype=np.float64).reshape(len(bits), len(BITS))


class Field:
    """weights: (features, 2) for the labels other (0) and text (1); moves: (2, 2) between neighbours."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self.known: dict[int, tuple[float, float]] = {}

    def scores(self, bits: int) -> tuple[float, float]:
        found = self.known.get(bits)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[bits] = tuple((matrix([bits]) @ self.weights)[0].tolist())
        return found

    def decode(self, bits: list[int]) -> list[bool]:
        """The most probable labels (Viterbi)."""
        (aa, ab), (ba, bb) = self.moves.tolist()
        back: list[tuple[bool, bool]] = []
        x = y = 0.0
        for k, b in enumerate(bits):
            p, q = self.scores(b)
            if k:
                back.append((y + ba > x + aa, y + bb >= x + ab))
                x, y = max(x + aa, y + ba) + p, max(x + ab, y + bb) + q
            else:
                x, y = p, q
        label = y >= x
        out = [label] * bool(bits)
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[list[tuple[int, int]]], rounds: int = 120, rate: float = 0.15, decay: float = 0.02) -> Field:
    """The field of most likelihood (less a square penalty) for pages of (bits, label)."""
    longest = max(map(len, pages))
    x = matrix([b for page in pages for b, _ in page])
    y = np.zeros((len(pages), longest), dtype=np.int64)
    there = np.zeros((len(pages), longest), dtype=bool)
    for i, page in enumerate(pages):
        y[i, : len(page)] = [label for _, label in page]
        there[i, : len(page)] = True
    both = there[:, 1:] & there[:, :-1]
    observed = x.T @ np.eye(2)[y[there]]
    moved = np.zeros((2, 2))
    np.add.at(moved, (y[:, :-1][both], y[:, 1:][both]), 1)
    weights, moves, total = np.zeros((len(BITS), 2)), np.zeros((2, 2)), there.sum()
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, rounds + 1):
        emit = np.zeros((*there.shape, 2))
        emit[there] = x @ weights
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(ahead[:, t - 1, 0, None] + moves[0], ahead[:, t - 1, 1, None] + moves[1]) + emit[:, t]
            ahead[:, t] = np.where(there[:, t, None], new, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp(moves[:, 0] + (emit + behind)[:, t + 1, 0, None], moves[:, 1] + (emit + behind)[:, t + 1, 1, None])
            behind[:, t] = np.where(there[:, t + 1, None], new, 0)
        whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        single = np.exp(ahead + behind - whole[:, None, None])[there]
        pair = np.exp(ahead[:, :-1, :, None] + moves + (emit + behind)[:, 1:, None, :] - whole[:, None, None, None]) * both[..., None, None]
        slopes = ((observed - x.T @ single) / total - decay * weights / 100, (moved - pair.sum((0, 1))) / total - decay * moves / 100)
        for k, (value, slope) in enumerate(zip((weights, moves), slopes, strict=True)):
            first, second = state[2 * k], state[2 * k + 1]
            first += 0.1 * (slope - first)
            second += 0.01 * (slope**2 - second)
            value += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(weights, moves)


# -- labelled pages -----------------------------------------------------------------------------


def labelled_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """(html, main text's blocks) of an invented page."""
    syllables = "ka ro mi ten sul vor pe lan dri os ut em za chi no".split()
    pick = lambda *options: options[int(rng.integers(len(options)))]
    chance = lambda p: rng.random() < p
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(1, 4))))

    def sentence(low: int = 4, high: int = 24) -> str:
        words = [word() + ("," if chance(0.1) else "") for _ in range(int(rng.integers(low, high)))]
        return (" ".join(words).rstrip(",") + pick(".", ".", ".", "!", "?")).capitalize()

    def prose() -> str:
        return " ".join(sentence() for _ in range(int(rng.integers(1, 7))))

    def label() -> str:
        return " ".join(word() for _ in range(int(rng.integers(1, 5)))).capitalize()

    content: list[str] = []

    def said(text: str) -> str:
        content.append(text)
        return text

    def inline(text: str) -> str:
        words = text.split(" ")
        for _ in range(int(rng.integers(0, 3))):
            k = int(rng.integers(len(words)))
            words[k] = pick(f"<b>{words[k]}</b>", f"<em>{words[k]}</em>", f'<a href="/{k}">{words[k]}</a>', f"<code>{words[k]}</code>", f"<span>{words[k]}</span>")
        return " ".join(words)

    def links(n: int) -> str:
        return "".join(f'<li><a href="/x">{label()}</a></li>' for _ in range(n))

    def part() -> str:
        kind = rng.random()
        if kind < 0.55:
            return f"<p>{inline(said(prose()))}</p>"
        if kind < 0.62:
            return f"<p>{inline(said(sentence(1, 4)))}</p>"
        if kind < 0.72:
            return f"<{(t := pick('h2', 'h3', 'h4'))}>{said(label())}</{t}>"
        if kind < 0.80:
            return f"<{(t := pick('ul', 'ol'))}>" + "".join(f"<li>{inline(said(pick(sentence(), label())))}</li>" for _ in range(int(rng.integers(2, 6)))) + f"</{t}>"
        if kind < 0.85:
            return f"<blockquote>{pick('<p>%s</p>', '%s') % said(prose())}</blockquote>"
        if kind < 0.90:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{said(pick(label(), sentence(2, 6)))}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        if kind < 0.94:
            return f'<figure><img src="i.png"><figcaption>{said(sentence())}</figcaption></figure>'
        if kind < 0.97:
            return f"<pre>{said(sentence())}</pre>"
        return f"<div>{inline(said(prose()))}</div>"

    def comment() -> str:
        return pick("<div class='comment'><p>%s</p></div>", "<li><p>%s</p></li>", "<article class='comment'><h4>" + label() + "</h4><p>%s</p></article>", "<div class='reply'>%s</div>") % prose()

    def advert() -> str:
        name = pick("ad", "advert", "sponsored", "promo", "ad-slot", "banner", "ads")
        return pick(f'<div class="{name}">%s</div>', f'<aside class="{name}"><p>%s</p></aside>', f'<div id="{name}"><p>%s</p></div>') % pick(prose(), sentence())

    def notice() -> str:
        name = pick("cookie-notice", "notice", "alert", "consent", "newsletter", "cookie-banner", "popup", "notification")
        return pick(f'<div class="{name}"><p>%s</p><button>{label()}</button></div>', f'<div id="{name}">%s</div>', '<div role="alert">%s</div>', f'<section class="{name}"><p>%s</p></section>', "<dialog><p>%s</p></dialog>") % pick(prose(), sentence())

    def form() -> str:
        return f'<form action="/go"><label>{label()}</label><input name="q"><select><option>{label()}</option><option>{label()}</option></select><p>{sentence()}</p><button>{label()}</button></form>'

    def aside() -> str:
        inner = pick(f"<h3>{label()}</h3><ul>{links(4)}</ul>", f"<p>{prose()}</p>", f"<h3>{label()}</h3><p>{sentence()}</p>")
        return pick("<aside>%s</aside>", '<div class="sidebar">%s</div>', '<div id="sidebar">%s</div>', '<section class="related">%s</section>', '<div class="widget">%s</div>') % inner

    def menu() -> str:
        return pick("<nav><ul>%s</ul></nav>", '<div class="menu"><ul>%s</ul></div>', '<ul class="navigation">%s</ul>', '<div id="nav"><ul>%s</ul></div>', '<ol class="breadcrumb">%s</ol>') % links(int(rng.integers(2, 8)))

    def header() -> str:
        inner = pick(f"<h1>{label()}</h1><p>{sentence()}</p>", f'<a href="/">{label()}</a>', f"<p>{label()}</p>", f"<h2>{label()}</h2>")
        return pick("<header>%s</header>", '<div class="header">%s</div>', '<div id="masthead">%s</div>') % inner

    def footer() -> str:
        inner = pick(f"&copy; 2020 {label()} &middot; {sentence()}", f"<p>{sentence()}</p>", f"<p>{prose()}</p><ul>{links(3)}</ul>", f"<p>&copy; {label()}</p>")
        return pick("<footer>%s</footer>", '<div class="footer">%s</div>', '<div id="footer">%s</div>') % inner

    before = [f() for f in (header, menu, notice, advert, form) if chance(0.5)]
    if chance(0.7):
        head = pick("<h1>%s</h1>", "<header><h1>%s</h1></header>") if chance(0.4) else "<h1>%s</h1>"
        body = [head % said(pick(label(), sentence(3, 10)))]
    else:
        body = []
    for _ in range(int(rng.integers(1, 9))):
        body.append(part())
        if chance(0.12):
            body.append(pick(advert, aside, form, notice, lambda: f'<div class="share"><a href="#">{label()}</a> <a href="#">{label()}</a></div>')())
    talk = [comment() for _ in range(int(rng.integers(1, 6)))]
    comments = pick('<section class="comments"><h2>' + label() + "</h2>%s</section>", '<div id="comments">%s</div>', '<ol class="commentlist">%s</ol>', '<div class="comments"><h3>' + label() + "</h3>%s</div>") % "".join(talk) if chance(0.45) else ""
    if comments and chance(0.4):
        body.append(comments)
        comments = ""
    wrap = pick("<article>%s</article>", "<article>%s</article>", "<main>%s</main>", "<main><article>%s</article></main>", '<div class="content">%s</div>', '<div id="content">%s</div>', '<div class="post">%s</div>', '<div class="article-body">%s</div>', "<section>%s</section>", "<div>%s</div>", "%s")
    after = [f() for f in (aside, advert, form, footer, notice, menu) if chance(0.45)]
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{label()}</title><script>var a = "<p>{sentence()}</p>";</script></head><body>' + "".join([*before, wrap % "".join(body), comments, *after]) + "</body></html>", content


def labelled(n: int, seed: int) -> list[list[tuple[int, int]]]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        page, content = labelled_page(rng)
        own, found = set(content), blocks(page)
        if found:
            out.append([(bits, int(text in own)) for text, bits in found])
    return out


_fields: dict[tuple[int, int], Field] = {}


def default_field(pages: int = 400, seed: int = 7) -> Field:
    """The field trained on generated pages; made once in a process."""
    key = (pages, seed)
    if key not in _fields:
        _fields[key] = train(labelled(pages, seed))
    return _fields[key]


def extract(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    return "\n".join(text for (text, _), keep in zip(found, field.decode([b for _, b in found]), strict=True) if keep)


def main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text) of every row: the main text's blocks joined by line feeds.

    A null or empty page, or one without main text, gives an empty text. Whole pages are read,
    however long, cut off or malformed; repeated rows are kept."""
    ship(pages.sparkSession)
    field = field or default_field()
    weights, moves = field.weights, field.moves
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(weights, moves)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(page.as_py(), own) for page in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")
