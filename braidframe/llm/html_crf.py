"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page's element tree.

A page is cut into blocks at block-level tags; every block has features of its ancestors (tags, words of class and id) and of its
text (length, links, punctuation, place). A two-label chain (main or not) is trained on labelled pages by gradient ascent of the
exact likelihood and decoded by Viterbi. The labelled pages are written by :func:`labelled_pages`, ``training_pages`` of them
under a fixed seed (a documented bound); the model is a few hundred weights, trained once on the driver and shipped with the task.

Tags are read as browsers read them: a self-closing slash means something in foreign content (svg, math) alone, quotes within unquoted
attribute values are part of them, ``<`` before anything but a letter, ``/``, ``!`` or ``?`` is text, drawings end at the next HTML
block even where their end tag is missing, and character references are decoded within one run of text. Reading takes time in
proportion to the page however deep its elements lie.

Defined results: null or empty html, and pages without a main block, give an empty text; text outside any element is a block; a
page that is cut off in a tag or a reference is read up to there; a page of any length is read whole; repeated rows are read each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose tags separate blocks, elements without content, elements whose content is no text of the page
#: (up to their end tag, or the page's end), and elements that end a drawing whose end tag is missing.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea iframe title noembed noframes xmp annotation annotation-xml".split())
BREAKS_OUT = (BLOCK | frozenset("b big br code em embed i img nobr ruby s small span strike strong sub sup tt u var".split())) - {"title"}

_ATTRIBUTES = r"""(?:\s++|/(?!>)|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+)*+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(/?)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))""", re.I)
_NAME_WORD = re.compile(r"[a-z]+")


class Block:
    """``inside``: the tags of the elements around the block's own; ``names``: words of their classes, ids and roles, with its own."""

    __slots__ = ("text", "tag", "inside", "names", "link_chars")

    def __init__(self, text: str, tag: str, inside: frozenset[str], names: frozenset[str], link_chars: int):
        self.text, self.tag, self.inside, self.names, self.link_chars = text, tag, inside, names, link_chars


class _Open:
    """An open element; what lies around it is shared with its parent where it adds nothing, so depth costs nothing."""

    __slots__ = ("tag", "inside", "around", "names")

    def __init__(self, tag: str, own: Iterable[str], parent: _Open | None):
        self.tag = tag
        self.inside: frozenset[str] = parent.around if parent else frozenset()
        self.around = self.inside if tag in self.inside else self.inside | {tag}
        names: frozenset[str] = parent.names if parent else frozenset()
        self.names = names.union(own) if any(x not in names for x in own) else names


def leaf_blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The page's blocks of text, in page order; white space within a block is one space. Of names only ``known`` words are kept."""
    out: list[Block] = []
    stack: list[_Open] = []
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    link_parts = in_link = at = 0
    drawing = 0  # open svg elements

    def flush() -> None:
        nonlocal link_parts
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1] if stack else None
                out.append(Block(text, top.tag if top else "", top.inside if top else frozenset(), top.names if top else frozenset(), min(link_parts, len(text))))
            parts.clear()
        link_parts = 0

    def word(chunk: str) -> None:
        nonlocal link_parts
        if chunk and not drawing:
            chunk = entities.unescape(chunk)
            parts.append(chunk)
            if in_link:
                link_parts += len(chunk.strip())

    def pop() -> None:
        open_tags[stack.pop().tag] -= 1

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            word(page[at:])
            break
        word(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "svg":
            drawing = max(0, drawing - 1) if m[1] else drawing + (not m[4])
            continue
        if drawing:
            if m[1] or tag not in BREAKS_OUT:
                continue
            drawing = 0
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCK:
                flush()
                if open_tags[tag]:
                    while stack[-1].tag != tag:
                        pop()
                    pop()
            continue
        if tag in RAW:
            if not (m[4] and tag.startswith("annotation")):
                close = _end_tag(tag).search(page, at)
                at = close.end() if close else end
            if tag in BLOCK:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag in BLOCK:
            flush()
            in_link = 0
            if stack and (stack[-1].tag == "p" or (tag in ("li", "dd", "dt", "tr", "td", "th", "option") and stack[-1].tag == tag)):
                pop()
            if tag not in VOID:
                found = " ".join(a or b or c for a, b, c in _NAMES.findall(m[3])).lower() if m[3] else ""
                own = _NAME_WORD.findall(found) if found else []
                stack.append(_Open(tag, own if known is None else [x for x in own if x in known], stack[-1] if stack else None))
                open_tags[tag] += 1
    flush()
    return out


@lru_cache(maxsize=64)
def _end_tag(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*(?:>|\Z)", re.I)


def block_features(blocks: list[Block]) -> list[list[str]]:
    out = []
    n = len(blocks)
    for k, b in enumerate(blocks):
        text, words = b.text, b.text.count(" ") + 1
        f = ["bias", f"tag={b.tag}", f"words={min(int(np.log2(words)), 7)}", f"chars={min(len(text).bit_length(), 12)}"]
        f += [f"in={t}" for t in b.inside] + [f"name={w}" for w in b.names]
        f.append(f"links={0 if not b.link_chars else 1 + min(3, 4 * b.link_chars // (len(text) + 1))}")
        f.append(f"end={'stop' if text[-1] in '.!?…。' else 'other'}")
        f.append(f"commas={min(3, text.count(','))}")
        if text[0] == "©" or "©" in text or "copyright" in text.lower():
            f.append("copyright")
        if b.tag not in ("article", "main") and not b.inside & {"article", "main"}:
            f.append("outside")
        # places mean something in pages of several blocks only
        f += [f"place={4 * k // n}"] * (n > 3) + ["first"] * (k == 0 < n - 3) + ["last"] * (k == n - 1 > 2)
        out.append(f)
    return out


class ChainModel:
    """Weights of a linear chain with the labels 0 (other) and 1 (main)."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move
        self.names = frozenset(x[5:] for x in index if x.startswith("name="))

    def scores(self, features: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(features), 2))
        for k, f in enumerate(features):
            ids = [self.index[x] for x in f if x in self.index]
            out[k] = self.emit[ids].sum(axis=0)
        return out

    def decode(self, features: list[list[str]]) -> list[int]:
        """The labels of highest joint score (Viterbi)."""
        if not features:
            return []
        s = self.scores(features).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            from0, from1 = (a + m00, b + m10), (a + m01, b + m11)
            back.append((from0[1] > from0[0], from1[1] > from1[0]))
            a, b = max(from0) + x, max(from1) + y
        label = int(b > a)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> ChainModel:
    """Maximum likelihood by Adam, with forward-backward in log space over all sequences at once."""
    index: dict[str, int] = {}
    for features, _ in pages:
        for f in features:
            for x in f:
                index.setdefault(x, len(index))
    n, longest = len(pages), max(len(y) for _, y in pages)
    rows, cols, gold, mask = [], [], np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (features, y) in enumerate(pages):
        mask[i, : len(y)] = True
        gold[i, : len(y)] = y
        for t, f in enumerate(features):
            rows += [i * longest + t] * len(f)
            cols += [index[x] for x in f]
    rows_, cols_ = np.array(rows), np.array(cols)
    w, move = np.zeros((len(index), 2)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)]
    one = np.eye(2)[gold] * mask[..., None]
    gold_moves = np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:])
    for step in range(1, steps + 1):
        e = np.zeros((n * longest, 2))
        np.add.at(e, rows_, w[cols_])
        e = e.reshape(n, longest, 2)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            nxt = np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, axis=1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = np.logaddexp.reduce(move[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], nxt, 0.0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        at = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pairs = np.exp(alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        gw = np.zeros_like(w)
        np.add.at(gw, cols_, (one - at).reshape(-1, 2)[rows_])
        for k, (x, g) in enumerate(((w, gw / n - penalty * w), (move, (gold_moves - pairs.sum(axis=(0, 1))) / n - penalty * move))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ChainModel(index, w, move)


def labelled_pages(count: int, seed: int = 3) -> list[tuple[str, list[str]]]:
    """(html, texts of its main blocks): pages of many makes, with invented words."""
    r = random.Random(seed)
    syllables = "an be co da el fi go ha in ju ka lo me no or pa qui re so ta un ve wi xo ya ze tion ment ly ing".split()
    serial = iter(range(10**9))

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.choice((1, 2, 2, 3))))

    def phrase(low: int, high: int, stop: bool) -> str:
        w = [word() + ("," if stop and r.random() < 0.1 else "") for _ in range(r.randint(low, high))]
        w[r.randrange(len(w))] += str(next(serial)) if r.random() < 0.02 else ""
        return (" ".join(w)).capitalize() + (r.choice(".....!?") if stop else "")

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(phrase(3, 16, True) for _ in range(r.randint(low, high)))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{phrase(1, 3, False)}</a></li>' for _ in range(k))

    def named(tag: str, names: tuple[str, ...], inner: str, bare: float = 0.2) -> str:
        return f"<{tag}>{inner}</{tag}>" if r.random() < bare else f'<{tag} {r.choice(("class", "class", "id"))}="{r.choice(names)}">{inner}</{tag}>'

    def short() -> tuple[str, list[str]]:
        """A page of one or two paragraphs and little else, also without a head or a body."""
        paragraphs = [prose(1, 4) for _ in range(r.choice((1, 1, 1, 2)))]
        inner = "".join(f"<p>{entities.escape(x)}</p>" for x in paragraphs)
        shape = r.random()
        if shape < 0.4:
            inner = f"<article>{inner}</article>"
        elif shape < 0.6:
            inner = f"<main>{inner}</main>"
        elif shape < 0.75:
            inner = named("div", ("content", "post", "entry", "text"), inner, 0.3)
        around = r.random()
        if around < 0.3:
            inner = f"<nav><ul>{links(3)}</ul></nav>{inner}"
        if 0.2 < around < 0.5:
            inner += f"<footer>&copy; {word()}</footer>"
        return (inner if r.random() < 0.4 else f"<html><body>{inner}</body></html>"), paragraphs

    pages = []
    for _ in range(count):
        if r.random() < 0.12:
            page, main = short()
            pages.append((page, [" ".join(t.split()) for t in main]))
            continue
        main = []

        def body(tag: str, text: str, keep: list[str] = main) -> str:
            keep.append(text)
            return f"<{tag}>{entities.escape(text)}</{tag}>"

        title = phrase(3, 10, r.random() < 0.5)
        parts = [body("h1", title)] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.08:
                parts.append(body("h2", phrase(2, 6, False)))
            elif kind < 0.14:
                parts.append("<ul>" + "".join(body("li", phrase(3, 12, True)) for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.16:
                parts.append("<pre>" + body("code", phrase(3, 20, False)) + "</pre>")
            elif kind < 0.18:
                parts.append("<table>" + "".join("<tr>" + body("td", phrase(1, 4, False)) + body("td", phrase(1, 6, False)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif kind < 0.2:
                parts.append("<figure><img src=x.png>" + body("figcaption", phrase(3, 14, True)) + "</figure>")
            elif kind < 0.22:
                parts.append("<dl>" + "".join(body("dt", phrase(1, 3, False)) + body("dd", phrase(3, 12, True)) for _ in range(r.randint(1, 3))) + "</dl>")
            elif kind < 0.27:
                parts.append("<blockquote>" + body("p", prose(1, 3)) + "</blockquote>")
            else:
                parts.append(body("p", prose(1, 7) if r.random() < 0.9 else phrase(1, 4, True)))
            if r.random() < 0.06:
                parts.append(named("div", ("ad", "advert", "sponsored", "promo", "banner"), entities.escape(prose(1, 2)), 0.0))
            if r.random() < 0.04:
                parts.append(named("div", ("share", "social", "related", "newsletter"), f"<ul>{links(3)}</ul>", 0.0))
        article = "".join(parts)
        shape = r.random()
        if shape < 0.55:
            article = f"<article>{article}</article>"
        elif shape < 0.7:
            article = f"<main>{article}</main>"
        else:
            article = named("div", ("content", "post", "entry", "article", "main", "story", "body"), article, 0.1)
        before, after = [], []
        if r.random() < 0.5:
            before.append(named("header", ("header", "masthead", "top"), r.choice(("", f"<h1>{phrase(1, 3, False)}</h1>")) + f"<p>{phrase(2, 7, r.random() < 0.5)}</p>"))
        if r.random() < 0.2:
            before.append(named("div", ("header", "masthead", "topbar"), f"<p>{phrase(2, 7, True)}</p>", 0.0))
        if r.random() < 0.85:
            before.append(named(r.choice(("nav", "nav", "div")), ("nav", "menu", "navigation", "breadcrumb"), f"<ul>{links(r.randint(2, 7))}</ul>", 0.0) if r.random() < 0.3 else f"<nav><ul>{links(r.randint(2, 7))}</ul></nav>")
        for place in (before, after):
            if r.random() < 0.45:
                place.append(named("div", ("ad", "ads", "advert", "sponsor", "banner", "promo"), entities.escape(prose(1, 2)), 0.0))
            if r.random() < 0.2:
                place.append(named(r.choice(("div", "section")), ("cookie", "notice", "consent", "alert", "popup", "modal", "gdpr"), f"<p>{prose(1, 2)}</p><button>{word()}</button>", 0.0))
            if r.random() < 0.1:
                place.append(f"<noscript>{prose(1, 1)}</noscript>")
            if r.random() < 0.15:
                place.append(f'<form action="/{word()}">' + f"<p>{phrase(2, 8, True)}</p><label>{word()}</label><input name=q><button>{word()}</button></form>")
            if r.random() < 0.25:
                place.append(named("aside", ("sidebar", "widget", "related"), f"<h3>{phrase(1, 3, False)}</h3><ul>{links(4)}</ul><p>{prose(1, 2)}</p>", 0.4))
            if r.random() < 0.1:
                place.append(named("div", ("sidebar", "widget", "rail", "related"), f"<h3>{phrase(1, 3, False)}</h3><p>{prose(1, 2)}</p>", 0.0))
        if r.random() < 0.35:
            talk = "".join(f"<{t}><p>{prose(1, 3)}</p></{t}>" for t in [r.choice(("div", "li", "article"))] * r.randint(1, 4))
            after.insert(0, named(r.choice(("div", "section")), ("comments", "comment", "discussion", "responses", "replies", "comment-list"), f"<h3>{phrase(1, 3, False)}</h3>{talk}", 0.0))
        if r.random() < 0.9:
            after.append(named(r.choice(("footer", "footer", "div")), ("footer", "bottom", "copyright"), f"&copy; {word()}.example &middot; {prose(1, 1)}", 0.0) if r.random() < 0.4 else f"<footer>{r.choice(('&copy; ', ''))}{word()}.example &middot; {prose(1, 1)}</footer>")
        r.shuffle(before)
        head = f"<head><title>{title}</title><style>p{{}}</style><script>x('</p>')</script></head>" if r.random() < 0.8 else ""
        pages.append((f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{article}{''.join(after)}</body></html>", [" ".join(t.split()) for t in main]))
    return pages


@lru_cache(maxsize=4)
def trained(training_pages: int = 500, seed: int = 3) -> ChainModel:
    examples = []
    for page, main in labelled_pages(training_pages, seed):
        blocks, wanted = leaf_blocks(page), set(main)
        examples.append((block_features(blocks), [int(b.text in wanted) for b in blocks]))
    return train(examples)


def main_text(page: str, model: ChainModel) -> str:
    blocks = leaf_blocks(page, model.names)
    return "\n".join(b.text for b, y in zip(blocks, model.decode(block_features(blocks))) if y)


SCHEMA = "page_id long, url string, text string, n_chars long"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extracted(pages: DataFrame, model: ChainModel | None = None) -> DataFrame:
    """page_id, url, main text and its length of every page."""
    model = model or trained()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [main_text(x.as_py() or "", model) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=_ARROW)

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
