"""Main text of web pages by a linear-chain conditional random field.

Method.  A page is read tag by tag into leaf blocks: runs of text between
block-level tags, with their open ancestors.  Each block has features of its
ancestors (tags and class or id words of page furniture and of content, forms that
hold the lesser part of the page), and of its text (length, share of link text,
closing punctuation, copyright sign, place).  A linear-chain CRF over the blocks
labels them content or not; Viterbi decodes.

The CRF is trained on hand-labelled pages (labelled_pages.py) whose labels are marks
on the blocks: the flags of the markup are features only, and training finds what
each is worth, from weights of 0.  Labelled pages of one's own can be added: rows with
the wanted text in `label_col` (a block is content if it is a line of that text), at
most about `pages` of them, chosen among the labelled rows by a hash of the id.

The text: character references decoded, white space inside a block as one space,
blocks trimmed and joined by a line break.  script, style, head, template and iframe,
what a textarea holds, and comments of the markup are never text.

Edge cases: null or empty html gives "" and 0; unclosed and stray tags are
tolerated; a page without content blocks gives ""; text outside all tags is a block;
very long pages are read whole, and time and memory grow with their length; ties of
the two labels go to "not content"; rows with one page id, and repeated rows, are
each extracted; an empty table gives an empty table; extra columns pass through; a
result column replaces an input column of its name.
"""

from __future__ import annotations

import html as entities
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import extended, with_columns
from .labelled_pages import MARK, pages as hand_labelled

#: fixed values: HTML's block-level tags, raw-text tags, and void tags
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style template iframe head textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"body", "html", "button"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div section article main body aside nav form".split())
#: fixed values: tags and class or id words of page furniture and of content
FURNITURE_TAGS = frozenset("nav header footer aside menu button select dialog".split())
FURNITURE = frozenset("ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar header masthead topbar footer foot bottom sidebar side aside rail widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay subscribe newsletter signup login form search comment comments discussion respond reply replies disqus feedback social share sharing related recommended recommendations more trending popular tags breadcrumb breadcrumbs pagination pager copyright legal disclaimer toolbar tool meta".split())
#: words that make a class name one of page layout ("has-sidebar"), whatever else it names
LAYOUT = frozenset("has with no without layout page wrapper container grid row".split())
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT = frozenset("article content story post entry main maincontent body text articlebody postbody".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
PART = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
END = re.compile(r"[.!?…:;\"”»)]$")

NAMES = ("bias", "furniture_tag", "furniture_word", "content_tag", "content_word", "heading", "paragraph", "item", "links", "short", "long", "size", "ends", "copyright", "first", "last", "hidden", "form", "unmarked", "unmarked_size", "unmarked_ends", "unmarked_heading", "mixed_word", "links_inside", "listed_links_inside")


#: what an element, or one of those around it, tells of a block
EVIDENCE = ("furniture_tag", "furniture_word", "content_tag", "content_word", "hidden", "mixed_word")


def _named(value: str) -> tuple[bool, bool, bool]:
    """(furniture, content, both apart) of a class or id.

    Names are read one by one. One name of words of both kinds is furniture ("sidebar-content"), but the header of an article or entry is
    neither. Names of both kinds side by side ("popular story") are evidence of its own kind, for training to weigh.
    """
    furniture = content = layout = False
    for name in value.split():
        parts = {p.lower() for p in PART.findall(CAMEL.sub(" ", name))}
        mine, wanted = parts & FURNITURE, parts & CONTENT
        layout |= bool(parts & LAYOUT)
        if mine == {"header"} and wanted:
            continue
        furniture |= bool(mine)
        content |= bool(wanted) and not mine
    furniture &= not layout
    return (False, False, True) if furniture and content else (furniture, content, False)


def _evidence(tag, attrs, inside):
    """EVIDENCE of one element. inside: the evidence of what is around it; the header of an article is no furniture."""
    word = content = hidden = mixed = False
    if attrs:
        for name, value in ATTR.findall(attrs):
            value, name = value.strip("\"'"), name.lower()
            if name == "role":
                word |= value.lower() in ROLES
                content |= value.lower() in ("main", "article")
            elif name in ("class", "id"):
                named = _named(value)
                word, content, mixed = word | named[0], content | named[1], mixed | named[2]
            elif name == "hidden":
                hidden = True
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            else:
                hidden |= value.lower() == "true"
    own_header = tag == "header" and inside[2]
    if tag in ("body", "html", "main", "article"):
        word = mixed = False
    return tag in FURNITURE_TAGS and not own_header, word, tag in CONTENT_TAGS, content and not word and tag not in ("body", "html"), hidden, mixed


def blocks_of(page: str):
    """[(text, characters of link text, block tag, evidence of the ancestors, nearest form)] in page order; forms count from 1."""
    out: list[tuple] = []
    forms: list[int] = []  # forms that are open
    forms_seen = 0
    stack: list[tuple[str, tuple]] = []  # block-level and link elements that are open, with the evidence down to them
    none = (False,) * len(EVIDENCE)
    parts: list[str] = []
    linked = 0
    in_link = False

    def flush():
        nonlocal parts, linked
        if parts:
            raw = "".join(parts)
            text = " ".join(entities.unescape(raw).split())
            if text:
                tag, seen = stack[-1] if stack else ("", none)
                out.append((text, min(linked, len(text)), tag, seen, forms[-1] if forms else 0))
            parts, linked = [], 0

    def text(piece):
        nonlocal linked
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
                if tag == "form" and forms:
                    forms.pop()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif tag == "a":
                in_link = False
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                close = re.compile(f"</{tag}\\b[^>]*>" + ("|(?=<body\\b)" if tag == "head" else ""), re.I).search(page, at)
                at = close.end() if close else size
            continue
        if tag == "br":
            text(" ")
        elif tag == "a":
            in_link = True
        if tag not in BLOCKS:
            continue
        flush()
        in_link = False
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            while stack and stack[-1][0] == "p":
                stack.pop()
        if tag in SAME:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SAME[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE:
                    break
        if tag == "form":
            forms_seen += 1
            forms.append(forms_seen)
        inside = stack[-1][1] if stack else none
        stack.append((tag, tuple(a or b for a, b in zip(inside, _evidence(tag, m[3], inside)))))
    flush()
    return out


def features_of(blocks) -> np.ndarray:
    x = np.zeros((len(blocks), len(NAMES)), np.float32)
    held = np.bincount([b[4] for b in blocks], [len(b[0]) for b in blocks]) if blocks else np.zeros(1)
    page = held.sum()
    # a page that has no content tag or word anywhere is told by its text
    marked = any((c or w) and not (f or g or h) for _, _, _, (f, g, c, w, h, _), _ in blocks)
    for i, (text, linked, tag, (ftag, fword, ctag, cword, hidden, mixed), form) in enumerate(blocks):
        words, furniture = text.count(" ") + 1, ftag or fword
        inside, links = (ctag or cword) and not furniture, linked / len(text)
        size, ends, heading = min(np.log1p(len(text)) / 6, 2), END.search(text) is not None, len(tag) == 2 and tag[0] == "h" and tag != "hr"
        x[i] = (
            1, ftag, fword, ctag and not furniture, cword and not furniture, heading, tag in ("p", "blockquote", "pre"), tag in ("li", "dt", "dd", "td", "th"), links, words < 5, words > 15,
            size, ends, "©" in text, i == 0, i == len(blocks) - 1, hidden, form > 0 and 2 * held[form] < page, not marked, 0 if marked else size, not marked and ends, not marked and heading, mixed and not furniture, links if inside else 0, links if inside and tag in ("li", "dd", "td") else 0,
        )
    return x


def labels_of(blocks, wanted: str) -> np.ndarray:
    """1 for blocks that are lines of the wanted text."""
    lines = {" ".join(line.split()) for line in wanted.split("\n")}
    return np.array([b[0] in lines for b in blocks], np.int64)


def read_marked(page: str):
    """(blocks, labels) of a page whose content blocks begin with MARK."""
    blocks, labels = [], []
    for text, linked, *rest in blocks_of(page):
        labels.append(text.startswith(MARK))
        text = text.removeprefix(MARK).strip()
        blocks.append((text, min(linked, len(text)), *rest))
    return blocks, np.array(labels, np.int64)


def _padded(pages):
    longest = max(len(p) for p in pages)
    x = np.zeros((len(pages), longest, len(NAMES)))
    mask = np.zeros((len(pages), longest), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, True
    return x, mask


def _lse(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@cache
def _hand_trained():
    blocks, labels = zip(*map(read_marked, hand_labelled()))
    crf = Crf.fit([features_of(b) for b in blocks], labels)
    return crf.weights, crf.moves


class Crf:
    """Weights of the features for content (state 1; state 0 has 0) and of the four transitions; by default those that the hand-labelled pages give."""

    def __init__(self, weights=None, moves=None):
        if weights is None:
            weights, moves = _hand_trained()
        self.weights, self.moves = np.array(weights, float), np.array(moves, float)

    @classmethod
    def fit(cls, pages, labels, steps: int = 300, rate: float = 0.1, pull: float = 0.003):
        """Maximum likelihood with a quadratic pull to 0; forward-backward over all pages at once."""
        crf = cls(np.zeros(len(NAMES)), np.zeros((2, 2)))
        if not pages:
            return crf
        x, mask = _padded(pages)
        y = np.zeros(mask.shape, np.int64)
        for i, v in enumerate(labels):
            y[i, : len(v)] = v
        n, longest = mask.shape
        both = mask[:, 1:] & mask[:, :-1]
        seen_moves = np.zeros((2, 2))
        np.add.at(seen_moves, (y[:, :-1][both], y[:, 1:][both]), 1)
        start, moved = crf.weights.copy(), crf.moves.copy()
        theta = np.concatenate([start, moved.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            w, t = theta[:-4], theta[-4:].reshape(2, 2)
            e = np.zeros((n, longest, 2))
            e[..., 1] = x @ w
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for k in range(1, longest):
                fwd[:, k] = np.where(mask[:, k, None], _lse(fwd[:, k - 1, :, None] + t, 1) + e[:, k], fwd[:, k - 1])
            for k in range(longest - 2, -1, -1):
                bwd[:, k] = np.where(mask[:, k + 1, None], _lse(t + (e[:, k + 1] + bwd[:, k + 1])[:, None, :], 2), 0)
            z = _lse(fwd[:, -1], 1)
            p = np.exp(fwd + bwd - z[:, None, None])[..., 1] * mask
            pair = np.exp(fwd[:, :-1, :, None] + t + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
            grad = np.concatenate([np.einsum("nt,ntf->f", (y - p) * mask, x), (seen_moves - pair.sum(axis=(0, 1))).ravel()]) / mask.sum() - pull * theta / 10
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(theta[:-4], theta[-4:].reshape(2, 2))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi path over one page."""
        score = (x @ self.weights).tolist()
        (t00, t01), (t10, t11) = self.moves.tolist()
        a, b, back = 0.0, score[0], []
        for s in score[1:]:
            to0, to1 = a >= b + t10 - t00, a + t01 > b + t11
            a, b = (a + t00 if to0 else b + t10), (a + t01 if to1 else b + t11) + s
            back.append((0 if to0 else 1, 0 if to1 else 1))
        state = int(b > a)
        path = [state]
        for pair in reversed(back):
            state = pair[state]
            path.append(state)
        return np.array(path[::-1])

    def text(self, page: str | None) -> str:
        blocks = blocks_of(page or "")
        if not blocks:
            return ""
        keep = self.decode(features_of(blocks))
        return "\n".join(b[0] for b, k in zip(blocks, keep) if k)


def fit(df: DataFrame | None = None, id_col: str = "page_id", html_col: str = "html", label_col: str | None = None, pages: int = 400) -> Crf:
    """A CRF from the hand-labelled pages, and from about `pages` of the rows of df that have a text in label_col."""
    if df is None or label_col is None:
        return Crf()
    rows = df.where(F.col(label_col).isNotNull() & F.col(html_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(html_col).alias("h"), F.col(label_col).alias("w"))
    share = min(1.0, pages / max(rows.count(), 1))
    rows = rows.where(F.pmod(F.xxhash64("i", "h"), F.lit(1 << 20)) < F.lit((1 << 20) * share))

    def featurize(batches):
        for batch in batches:
            got = []
            for i, h, w in zip(batch.column("i").to_pylist(), batch.column("h").to_pylist(), batch.column("w").to_pylist()):
                blocks = blocks_of(h)
                if blocks:
                    got.append((i or "", features_of(blocks).astype("<f4").tobytes(), labels_of(blocks, w).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip("ixy", g)) for g in got], schema=pa.schema([("i", pa.string()), ("x", pa.binary()), ("y", pa.binary())]))

    got = sorted(rows.mapInArrow(featurize, "i string, x binary, y binary").collect(), key=lambda r: (r["i"], bytes(r["x"])))
    ours = [read_marked(p) for p in hand_labelled()]
    x = [features_of(b) for b, _ in ours] + [np.frombuffer(r["x"], "<f4").reshape(-1, len(NAMES)) for r in got]
    return Crf.fit(x, [y for _, y in ours] + [np.frombuffer(r["y"], np.uint8).astype(np.int64) for r in got])


def extract(df: DataFrame, model: Crf, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """df with the main text and n_chars, its code points."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            texts = [sent.value.text(h) for h in batch.column(html_col).to_pylist()]
            yield with_columns(batch, **{text_col: pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return df.mapInArrow(work, extended(df.schema, **{text_col: "string", "n_chars": "long"}))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: per page the main text."""
    from .common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", "n_chars")
