"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM."""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigspark.llm.common import fresh_names

#: Elements that begin and end a block, that hold no content, and that are never text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset(["p"])
OWN_KIND = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "td": ("table", "tr"), "th": ("table", "tr"), "tr": ("table",), "option": ("select",)}

#: Comments, scripts and styles with their content, tags, declarations.  In a tag a quote counts
#: only where a value begins, after ``=``; elsewhere it is a plain character of a name or an
#: unquoted value.  A tag whose quoted value never ends is taken to end at the first ``>``.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|))*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*))", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Words that main elements are named by, and words after or before which a name
#: tells of a page's make, not of what the element holds.
MAIN_WORDS = frozenset("article body content copy entry hentry main page post prose single story text".split())
TELLING_OF = frozenset("with has have no without is not show hide".split())
STATES = frozenset("open closed enabled disabled active on off".split())
KINDS = frozenset("category tag tags type format status author".split())


def name_parts(tag: str, attributes: str) -> set[str]:
    """Words of an element's class, id, role and label.

    Names of main elements are full of words that tell of other parts (``post with-sidebar``,
    ``comments-open``, ``category-news``).  So what follows a word like *with* or *has*, and what
    stands before a state, is left out; and in an element that is an article or main, or has a
    name of main words only, all other words carry a mark and are learnt apart.
    """
    if not attributes:
        return set()
    names = [[p.lower() for p in _PART.findall(name)] for m in _NAMED.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").split()]
    kept = []
    for parts in names:
        at = next((i for i, p in enumerate(parts) if p in TELLING_OF), len(parts))
        if parts[-1:] and parts[-1] in STATES:
            at = 0
        kept.append(parts[:at])
    main = tag in ("article", "main") or any(parts and MAIN_WORDS.issuperset(parts) for parts in kept)
    words = {p for parts in kept for p in parts}
    return {p if p in MAIN_WORDS else f"{p}@main" for p in words} if main else words


@dataclass
class Block:
    """A leaf block: its text, what stands above it, and how many characters are links.

    ``above`` holds the tags and names of all elements around it, and once more, marked, those of
    the innermost block element.
    """

    text: str
    above: frozenset[str]
    links: int


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, with character references decoded and white space folded.

    Markup need not be well formed: an end without a start is ignored, an element left open ends
    with the one around it, and a paragraph or list item also where the next one begins.
    """
    out: list[Block] = []
    # Tag, features of all elements, features of the innermost block element, and both together.
    stack: list[tuple[str, frozenset[str], frozenset[str], frozenset[str]]] = [("", frozenset(), frozenset(), frozenset())]
    parts: list[str] = []
    linked: list[str] = []
    in_link = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1][3], len(" ".join("".join(linked).split()))))
            parts.clear()
            linked.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked.append(parts[-1])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            parts.append(" ") if m[1] else None
            continue
        closing = m[2] or m[5]
        block = tag in BLOCKS
        if tag == "br":
            parts.append(" ")
        if block:
            flush()
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                if not block and any(stack[i][0] in BLOCKS for i in range(depth + 1, len(stack))):
                    continue
                gone = stack[depth:]
                del stack[depth:]
                in_link -= sum(t == "a" for t, *_ in gone)
            continue
        if tag in VOID:
            continue
        if block:
            stop = 0
            if tag in OWN_KIND:
                limit = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in OWN_KIND[tag]), 0)
                stop = next((i for i in range(limit + 1, len(stack)) if stack[i][0] == tag or (tag in ("dd", "dt") and stack[i][0] in ("dd", "dt"))), 0)
            if not stop:
                stop = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in CLOSED_BY_BLOCK), 0)
                if any(stack[i][0] in BLOCKS for i in range(stop + 1, len(stack))):
                    stop = 0
            if stop:
                in_link -= sum(t == "a" for t, *_ in stack[stop:])
                del stack[stop:]
        _, above, inner, both = stack[-1]
        # Names of the whole page tell none of its blocks apart.
        names = name_parts(tag, m[4] or m[7] or "") if tag not in ("html", "body") else ()
        fresh = {f"<{tag}>", *(f".{p}" for p in names)}
        own = frozenset("=" + f for f in fresh) if block else inner
        if fresh <= above and own == inner:
            stack.append((tag, above, inner, both))
        else:
            above = above | fresh
            stack.append((tag, above, own, above | own))
        in_link += tag == "a"
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


#: Bounds of the buckets of a block's length, in characters.
LENGTHS = (15, 40, 80, 160, 400)


def text_features(block: Block, place: float) -> list[str]:
    """Names of the features of a block's own text."""
    text, n = block.text, len(block.text)
    out = ["bias", f"length{sum(n >= b for b in LENGTHS)}", f"links{0 if not block.links else 1 if block.links < 0.5 * n else 2}"]
    if text[-1] in ".!?…\"'»":
        out.append("sentence")
    if text[0] == "©" or "copyright" in text[:200].lower() or "all rights reserved" in text[:400].lower():
        out.append("rights")
    out.append("early" if place < 0.1 else "late" if place > 0.9 else "middle")
    return out


@dataclass
class Field:
    """Weights of the field: what speaks for main text in a block, and for each change of label."""

    weights: dict[str, float]
    change: np.ndarray

    def emission(self, block: Block, place: float, seen: dict[frozenset[str], float]) -> float:
        w = self.weights
        if (above := seen.get(block.above)) is None:
            above = seen[block.above] = sum(w.get(f, 0.0) for f in block.above)
        return above + sum(w.get(f, 0.0) for f in text_features(block, place))

    def decode(self, blocks: list[Block], seen: dict[frozenset[str], float]) -> list[bool]:
        """The most likely labels by Viterbi."""
        n = len(blocks)
        if not n:
            return []
        (t00, t01), (t10, t11) = self.change.tolist()
        off, on, back = 0.0, self.emission(blocks[0], 0.0, seen), []
        for i in range(1, n):
            e = self.emission(blocks[i], i / (n - 1), seen)
            back.append((on + t10 > off + t00, on + t11 >= off + t01))
            off, on = max(off + t00, on + t10), max(off + t01, on + t11) + e
        state, out = on >= off, []
        for choice in reversed(back):
            out.append(state)
            state = choice[state]
        out.append(state)
        return out[::-1]


def train_field(pages: list[tuple[list[Block], list[bool]]], rounds: int = 120, rate: float = 0.15, decay: float = 5e-5) -> Field:
    """Maximise the penalised log-likelihood of labelled pages by gradient ascent (Adam).

    The gradient is what is observed less what the forward-backward sums expect; pages are
    handled together, filled up to the longest.
    """
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in [*sorted(b.above), *text_features(b, i / max(len(bs) - 1, 1))]] for i, b in enumerate(bs)] for bs, _ in pages]
    count, longest = len(pages), max(len(r) for r in rows)
    x = np.zeros((count, longest, len(names)), np.float32)
    y, held = np.zeros((count, longest), int), np.zeros((count, longest), bool)
    for p, (r, (_, labels)) in enumerate(zip(rows, pages, strict=True)):
        for t, fs in enumerate(r):
            x[p, t, fs] = 1
        y[p, : len(r)], held[p, : len(r)] = labels, True
    flat = x[held]
    w, c = np.zeros(len(names)), np.zeros((2, 2))
    state = [np.zeros(len(names) + 4), np.zeros(len(names) + 4)]
    pair = held[:, 1:]
    seen_pairs = np.array([[np.sum(pair & (y[:, :-1] == a) & (y[:, 1:] == b)) for b in (0, 1)] for a in (0, 1)], float)
    seen_words = flat.T @ y[held].astype(np.float32)
    log_sum = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    for step in range(1, rounds + 1):
        e = np.zeros((count, longest, 2))
        e[held, 1] = flat @ w.astype(np.float32)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = np.stack([log_sum(forward[:, t - 1] + c[:, b]) for b in (0, 1)], -1) + e[:, t]
            forward[:, t] = np.where(held[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.stack([log_sum(backward[:, t + 1] + e[:, t + 1] + c[a]) for a in (0, 1)], -1)
            backward[:, t] = np.where(held[:, t + 1, None], new, 0.0)
        whole = log_sum(forward[:, -1])[:, None]
        on = np.exp(forward[..., 1] + backward[..., 1] - whole)[held]
        pairs = np.array([[np.exp(forward[:, :-1, a] + c[a, b] + e[:, 1:, b] + backward[:, 1:, b] - whole)[pair].sum() for b in (0, 1)] for a in (0, 1)])
        grad = np.r_[(seen_words - flat.T @ on.astype(np.float32)) / count - decay * w, ((seen_pairs - pairs) / count - decay * c).ravel()]
        state[0] += 0.1 * (grad - state[0])
        state[1] += 0.01 * (grad**2 - state[1])
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, c = w + move[:-4], c + move[-4:].reshape(2, 2)
    return Field({f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-6}, c)


#: Names that pages give to their parts; the labelled pages are drawn from these.
MAIN_NAMES = "content article article-body post post-body post-content entry entry-content story story-body main main-content text body-text page-content articleBody prose single"
PART_NAMES = {
    "nav": "nav navbar menu main-menu navigation breadcrumb breadcrumbs topnav site-nav pagination tabs toc skip-link links",
    "header": "header site-header masthead topbar top-bar logo branding banner search login account page-header",
    "footer": "footer site-footer foot bottom colophon copyright legal credits imprint",
    "aside": "sidebar side-bar side rail right-rail widget widget-area secondary related related-posts recommended more-stories trending popular tags tag-list author-box about-author",
    "ad": "ad ads advert advertisement adsense ad-slot ad-box adbox banner-ad sponsored sponsor promo promotion dfp outbrain taboola teaser",
    "notice": "cookie cookie-banner cookie-notice consent gdpr notice alert warning announcement disclaimer popup modal overlay newsletter subscribe signup paywall privacy",
    "comments": "comments comment comment-list commentlist comment-body reply replies respond discussion disqus thread reader-comments responses feedback",
    "share": "share sharing social social-share share-buttons toolbar tools actions print follow",
    "form": "form search-form contact-form login-form subscribe-form poll survey rating",
}


def labelled_pages(count: int = 700, seed: int = 2) -> list[tuple[list[Block], list[bool]]]:
    """Pages drawn at random from common layouts, each leaf block labelled main text or not.

    Main text carries a mark in its words while a page is put together; the blocks are then read
    off the page itself, so markup as careless as on real pages is labelled rightly.
    """
    rng = random.Random(seed)
    mark = ""
    letters = ["ra", "ten", "lo", "mi", "sha", "ver", "o", "est", "du", "ing", "ci", "al", "für", "é", "nt", "que"]

    def words(n: int) -> str:
        return " ".join("".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(n))

    def sentence(n: int) -> str:
        kind, text = rng.random(), words(n)
        if kind < 0.06:
            return text.upper().replace(" ", "!! ")
        if kind < 0.1:
            return text.replace(" ", " | ")
        if kind < 0.14:
            return text.replace(" ", "### ")
        return text[:1].upper() + text[1:] + rng.choice([".", ".", ".", ".", "!", "?", "", ":", ";"])

    def paragraph() -> str:
        return " ".join(sentence(rng.choice([1, 2, 4, 8, 12, 20])) for _ in range(rng.choice([1, 1, 1, 2, 3, 5, 8])))

    def named(kind: str) -> str:
        names = PART_NAMES[kind].split()
        name = rng.choice(names[:4] if rng.random() < 0.4 else names)
        if rng.random() < 0.12:  # named after what they belong to
            name = rng.choice(["post", "entry", "article", "content", "page"]) + "-" + name
        return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {rng.choice(["box", "wrap", "block", "x1"])}"', f" class='{name}'"])

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(rng.randint(1, 3))}</a></li>' for i in range(n)) + "</ul>"

    def part(kind: str, closed: float = 0.97) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        plain = rng.random() < 0.45
        open_ = f"<{tag}{named(kind) if rng.random() < 0.5 else ''}>" if plain and tag not in ("div", "section") else f"<{rng.choice(['div', 'div', 'section', 'aside' if kind == 'ad' else 'div'])}{named(kind)}>"
        close = f"</{re.match('<([a-z]+)', open_)[1]}>"
        inner = {
            "nav": lambda: links(rng.randint(3, 7)),
            "header": lambda: rng.choice([f"<h1>{words(2)}</h1>", f'<a href="/">{words(2)}</a>', f"<p>{words(4)}</p>"]) + rng.choice(["", links(4)]),
            "footer": lambda: rng.choice([f"&copy; {words(2)} &middot; {sentence(6)}", f"<p>Copyright 2020 {words(2)}. All rights reserved.</p>", f"<p>{paragraph()}</p>" + links(3)]),
            "aside": lambda: rng.choice([f"<h3>{words(2)}</h3>" + links(4), f"<p>{paragraph()}</p>", f"<h4>{words(2)}</h4><p>{sentence(8)}</p>"]),
            "ad": lambda: rng.choice([sentence(6), f"<p>{sentence(9)}</p>", f'<a href="/x">{sentence(5)}</a>', f"<span>{paragraph()}</span>"]),
            "notice": lambda: rng.choice([f"<p>{sentence(12)}</p><button>{words(1)}</button>", sentence(10), f"<p>{paragraph()}</p>"]),
            "comments": lambda: f"<h2>{words(2)}</h2>" * (rng.random() < 0.6) + "".join(rng.choice([f"<p>{paragraph()}</p>", f"<div><b>{words(1)}</b><p>{paragraph()}</p></div>", f"<article><p>{paragraph()}</p></article>"]) for _ in range(rng.randint(1, 5))),
            "share": lambda: links(3) if rng.random() < 0.6 else f"<span>{words(2)}</span><a href='/s'>{words(1)}</a>",
            "form": lambda: f"<label>{words(2)}</label><input name='q'><select><option>{words(1)}</option><option>{words(1)}</option></select><textarea>{words(2)}</textarea><button>{words(1)}</button>" + rng.choice(["", f"<p>{sentence(8)}</p>"]),
        }[kind]()
        return open_ + inner + (close if rng.random() < closed else "")

    def main() -> str:
        out = [f"<h1>{mark}{words(rng.randint(2, 9))}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice([1, 2, 3, 5, 8, 12])):
            text = mark + (paragraph() if rng.random() < 0.92 else rng.choice([f"Copyright 2021 {words(2)}.", f"Released under the {words(2)} License.", f"All rights reserved by {words(2)}.", f"&copy; {words(3)}"]))
            out.append(rng.choice([
                f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}", f"<div>{text}</div>", f"<h2>{mark}{words(4)}</h2><p>{text}</p>",
                f"<blockquote><p>{text}</p></blockquote>", f"<ul><li>{text}</li><li>{mark}{sentence(5)}</li></ul>", f"<ol><li>{text}<li>{mark}{sentence(3)}</ol>", f"<pre>{text}</pre>", f"<p>{text} <a href='/y'>{words(2)}</a></p>",
                f"<table><tr><td>{text}</td><td>{mark}{words(2)}</td></tr></table>", f"<figure><img src='i'><figcaption>{mark}{sentence(6)}</figcaption></figure><p>{text}</p>", f"<section><h3>{mark}{words(3)}</h3><p>{text}</p></section>",
            ]))
            if rng.random() < 0.3:
                out.append(part(rng.choice(["ad", "aside", "notice", "share", "form", "ad", "nav", "ad", "comments"]), 1.0))
        if rng.random() < 0.3:
            out.append(part(rng.choice(["comments", "share", "aside", "comments"]), 1.0))
        return "".join(out)

    def noise() -> str:
        """Further names of a main element, taken from the names of other parts."""
        other = rng.choice([n for names in PART_NAMES.values() for n in names.split()])
        return rng.choice([f"with-{other}", f"has-{other}", f"no-{other}", f"{other}-open", f"category-{other}", f"tag-{other}", f"post-{other}", f"type-post format-{other}", f"content-with-{other}", f"{other}-closed", "hentry", "status-publish", "x1 wide"])

    def some(name: str) -> str:
        return " ".join([*name.split()[:1], *(noise() for _ in range(rng.choice([0, 0, 1, 1, 2, 3])))])

    def stray() -> str:
        """Short parts that no name or tag tells: a word or link at the page's ends."""
        text = words(rng.randint(1, 2))
        return rng.choice([f"<div>{text}</div>", f"<div><a href='/'>{text}</a></div>", f"<table><tr><td><a href='/'>{text}</a></td></tr></table>", f"<div class='x{rng.randint(1, 9)}'>{text}</div>", f"<p><a href='/'>{text}</a></p>"])

    pages = []
    for _ in range(count // 20):  # text without markup, or with paragraphs only
        texts = [mark + paragraph() for _ in range(rng.randint(1, 4))]
        bare = "".join(f"<p>{t}</p>" for t in texts) if rng.random() < 0.5 else mark + paragraph()
        blocks = leaf_blocks(bare)
        pages.append(([Block(b.text.replace(mark, ""), b.above, b.links) for b in blocks if b.text.replace(mark, "")], [True for b in blocks if b.text.replace(mark, "")]))
    for _ in range(count):
        kind = rng.random()
        name = some(rng.choice(MAIN_NAMES.split()))
        open_, close = (rng.choice(["<article>", f"<article class='{name}'>"]), "</article>") if kind < 0.4 else ("<main>", "</main>") if kind < 0.5 else (f"<div class='{name}'>", "</div>") if kind < 0.75 else (f"<main><article class='{name}'>", "</article></main>") if kind < 0.85 else (f"<section id='{name}'>", "</section>") if kind < 0.93 else ("<div>", "</div>")
        before = [part(rng.choice(["nav", "header", "nav", "notice", "ad", "form", "header"])) for _ in range(rng.randint(1, 4))]
        after = [part(rng.choice(["footer", "aside", "comments", "ad", "footer", "nav", "notice", "form", "share"])) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.15:
            before.insert(0, stray())
        if rng.random() < 0.15:
            after.append(stray())
        around = ("", "")
        if rng.random() < 0.2:  # a layout's wrapper, named by what else it holds
            around = (f"<div class='{rng.choice(['wrap', 'container', 'layout', 'page'])} {noise()}'>", "</div>")
            if rng.random() < 0.5:
                before.append(around[0])
                after.insert(rng.randint(0, len(after)), around[1])
                around = ("", "")
        page = f"<html><head><title>{words(5)}</title></head><body>" + around[0] + "".join(before) + open_ + main() + (close if rng.random() < 0.95 else "") + "".join(after) + around[1] + rng.choice(["</body></html>", ""])
        blocks = leaf_blocks(page)
        labels = [mark in b.text for b in blocks]
        pages.append(([Block(b.text.replace(mark, ""), b.above, b.links) for b in blocks if b.text.replace(mark, "")], [k for k, b in zip(labels, blocks, strict=True) if b.text.replace(mark, "")]))
    return pages


@functools.cache
def default_field() -> Field:
    """The field trained on :func:`labelled_pages`."""
    return train_field(labelled_pages())


def main_text(page: str | None, field: Field, seen: dict[frozenset[str], float]) -> str:
    blocks = leaf_blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, field.decode(blocks, seen), strict=True) if keep)


def extract_text(pages: DataFrame, field: Field | None = None, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The input without its html, with the main text of each page as ``out_col``.

    Every page is read whole.  Null and empty pages, and pages without any main text, give an
    empty string; very long pages and repeated rows are handled like any other.  Rows are
    independent: no shuffle; a column named ``out_col`` is replaced, all others of any name stay.
    """
    field, held = field or default_field(), fresh_names(pages, "html")["html"]
    others = [f for f in pages.schema if f.name not in (html_col, out_col)]
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[frozenset[str], float] = {}
        for batch in batches:
            if len(seen) > 100_000:
                seen.clear()
            column = batch.column(batch.schema.get_field_index(held))
            texts = pa.array((main_text(v.as_py(), field, seen) for v in column), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), texts], [*names, out_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"`{out_col}` string"])
    return pages.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{html_col}`").alias(held)).mapInArrow(run, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    """Id, url, main text and its length in code points, for each page."""
    rows = extract_text(pages.select("page_id", "url", "html"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
