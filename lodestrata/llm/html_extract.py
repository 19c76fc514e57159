"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into blocks of text between block-level tags. Each has features of its ancestors' tags and class
names and of its text; a field of two labels scores the sequence, and Viterbi decoding picks the article's
blocks. The field is trained on a bounded sample of the pages, labelled by their structure (article or main,
without menus and the like) or, where a page has neither element, by density: text of few links that no other page of
the sample repeats, in the container with most of it. Further training pages are copies of those whose article
stands in other frames and that carry more parts around and within it: side bars, notices, forms, comments. No
feature says what the labels' rule says: the field weighs single tags, words of class names, and the text.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.text import pieces
from lodestrata.shipping import ship

SAMPLE, PAGE_BYTES = 200, 1 << 18  #: pages that the field is trained on at most, and the bytes of such a page
STEPS, RATE, SHRINK = 200, 0.1, 1e-3
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|iframe|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+)|<", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
OUT = frozenset("head nav header footer aside form menu button select textarea title dialog search option".split())
BAD = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|side|sidebar|aside|foot\w*|header|masthead|comments?|replies|respond|cookies?|notices?|consent|popup|modal|share|social|related|widget|newsletter|subscribe|form|login|breadcrumbs?)(?:$|[-_ ])")


class Block:
    __slots__ = ("path", "names", "text", "links")

    def __init__(self, path: tuple[str, ...], names: tuple[str, ...], text: str, links: int):
        self.path, self.names, self.text, self.links = path, names, text, links


def blocks(page: str) -> list[Block]:
    """The page's texts between block-level tags, in order; references decoded, white space one space, trimmed."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    links = depth = 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(tuple(t for t, _ in stack), tuple(n for _, n in stack if n), text, links))
        parts.clear()
        links = 0

    for m in TOKEN.finditer(page):
        _, slash, tag, rest, text = m.groups()
        if text is not None:
            text = html.unescape(text)
            parts.append(text)
            if depth:
                links += len(text)
        elif tag is None:
            if m[0] == "<":
                parts.append("<")
        else:
            tag = tag.lower()
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                depth = max(0, depth - 1) if slash else depth + 1
            elif tag in BLOCKS:
                flush()
                depth = 0
                if slash:
                    at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                    if at is not None:
                        del stack[at:]
                elif tag not in VOID:
                    closing = CLOSES.get(tag, {"p"})
                    while stack and stack[-1][0] in closing:
                        stack.pop()
                    names = " ".join(x for n in NAMES.findall(rest) for x in n if x).lower() if rest.strip() else ""
                    stack.append((tag, names))
    flush()
    return out


def features(b: Block, k: int, n: int) -> list[str]:
    """Of the ancestors' tags and names, and of the text."""
    size, words = len(b.text), b.text.split(" ", 40)
    out = ["*", f"leaf={b.path[-1] if b.path else ''}", f"size={min(size.bit_length(), 9)}", f"words={min(len(words).bit_length(), 6)}", f"links={4 * b.links // size}", f"place={4 * k // n}", f"last={k == n - 1}", f"stop={b.text[-1] in '.!?:'}", f"commas={min(b.text.count(','), 3)}"]
    out += [f"in={t}" for t in set(b.path)]
    out += [f"name={x}" for n_ in b.names for x in set(re.findall(r"[a-z]+", n_))]
    if b.text[0] in "©(" and size < 80:
        out.append("right")
    return out


def structural_labels(page: list[Block]) -> list[int] | None:
    """1 for the blocks of article or main without menus and the like; None if the page has neither."""
    if not any({"article", "main"} & set(b.path) for b in page):
        return None
    label = lambda b: int(bool({"article", "main"} & set(b.path)) and not any(t in OUT for t in b.path) and not any(BAD.search(n) for n in b.names))
    return [label(b) for b in page]


def density_labels(page: list[Block], common: set[str]) -> list[int]:
    """For a page without article or main: 1 for text of few links, said on no other page of the sample, in the
    container that holds most of such text."""
    inner = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li blockquote pre table tbody thead tr td th figure figcaption dl dt dd".split())

    def container(b: Block) -> tuple[tuple[str, ...], tuple[str, ...]]:
        path = list(b.path)
        while path and path[-1] in inner:
            path.pop()
        return tuple(path), b.names

    able = [not any(t in OUT for t in b.path) and not any(BAD.search(n) for n in b.names) and 2 * b.links < len(b.text) and b.text not in common for b in page]
    held: dict[tuple, int] = {}
    for b, y in zip(page, able, strict=True):
        if y:
            held[container(b)] = held.get(container(b), 0) + len(b.text)
    best = max(held, key=lambda c: (held[c], c), default=None)
    inside = lambda c: c[0][: len(best[0])] == best[0] and c[1][: len(best[1])] == best[1]
    return [int(y and inside(container(b))) for b, y in zip(page, able, strict=True)]


#: Names that parts of a page go by, for the copies in other frames: (tags, names, words, whether linked).
PARTS = (
    (("header",), ("site header", "masthead", "banner", "top header"), 4, False),
    (("div",), ("cookie notice", "consent", "cookies", "alert notice", "notices"), 18, False),
    (("div",), ("menu", "nav", "navigation menu", "breadcrumb", "breadcrumbs", "navbar"), 4, True),
    (("div",), ("advert", "ad", "ads", "sponsor", "sponsored", "promo", "advertisement"), 9, False),
    (("div",), ("popup modal", "newsletter", "subscribe", "share social", "widget"), 10, False),
    (("aside", "p"), ("sidebar", "side", "aside", "widget"), 25, False),
    (("div", "p"), ("sidebar", "side widget", "related"), 25, False),
    (("form", "div"), ("newsletter form", "login", "search form", ""), 6, False),
    (("section", "div", "p"), ("comments comment", "replies", "respond comment", "comment body"), 30, False),
    (("div", "p"), ("comments", "comment", "replies", "comment text"), 24, False),
    (("div", "ul", "li"), ("related links", "related", "share", "footer menu"), 5, True),
    (("div",), ("footer", "foot", "copyright footer", "site footer"), 7, False),
)
LEAVES = (("h2",), ("h3",), ("ul", "li"), ("table", "tr", "td"), ("table", "tr", "td", "table", "tr", "td"), ("blockquote",), ("div",), ("pre",))
CONTENT = ("content", "post", "entry content", "main text", "story body", "page content", "article body")


def variants(page: list[Block], labels: list[int], seed: int) -> list[tuple[list[Block], list[int]]]:
    """The page and three copies of it in other frames, with parts that it lacks made of its own words: around the
    article, and between its paragraphs."""
    r = np.random.default_rng(seed)
    words = " ".join(b.text for b in page).split()
    if not words:
        return []

    def part(head: tuple[str, ...]) -> tuple[Block, int]:
        tags, names, n, linked = PARTS[r.integers(len(PARTS))]
        text = " ".join(words[i] for i in r.integers(0, len(words), r.integers(max(1, n // 3), 2 * n))).rstrip(".") + ("." if r.random() < 0.6 and not linked else "")
        return Block((*head, *tags), tuple(x for x in (names[r.integers(len(names))],) if x), text, len(text) if linked else 0), 0

    out = [(page, labels)]
    for frame in (("main",), ("div", "div"), ("div",)):
        own = () if frame == ("main",) else (CONTENT[r.integers(len(CONTENT))],)
        moved = [(Block(tuple(t for p in b.path for t in (frame if p in ("article", "main") else (p,))), (*own, *b.names) if y else b.names, b.text, b.links), y) for b, y in zip(page, labels, strict=True)]
        first = next((k for k, (_, y) in enumerate(moved) if y), len(moved))
        last = max((k for k, (_, y) in enumerate(moved) if y), default=len(moved) - 1) + 1
        some = lambda head, most: [part(head) for _ in range(r.integers(0, most))]
        body = []
        for b, y in moved[first:last]:
            if y and b.path[-1:] == ("p",) and r.random() < 0.3:  # a heading, an item or a cell in place of a paragraph
                short = " ".join(b.text.split()[: r.integers(1, 8)])
                b = Block((*b.path[:-1], *LEAVES[r.integers(len(LEAVES))]), b.names, short if r.random() < 0.7 else b.text, 0)
            body.append((b, y))
            if r.random() < 0.15:
                inside = part(("html", "body", *frame))
                body.append((Block(inside[0].path, (*own, *inside[0].names), inside[0].text, inside[0].links), 0))
        seq = moved[:first] + some(("html", "body"), 5) + body + some(("html", "body", *(frame if r.random() < 0.5 else ())), 6) + moved[last:]
        out.append(([b for b, _ in seq], [y for _, y in seq]))
    return out


class Field:
    """Weights of features for label 1, and of the steps between labels."""

    def __init__(self, weights: dict[str, float], steps: list[list[float]], first: list[float]):
        self.weights, self.steps, self.first = weights, steps, first

    @classmethod
    def trained(cls, pages: list[tuple[list[Block], list[int]]]) -> Field:
        """Maximum conditional likelihood with an L2 term, by full-batch gradient steps with momentum scaling."""
        names: dict[str, int] = {}
        rows = [[[names.setdefault(f, len(names)) for f in features(b, k, len(p))] for k, b in enumerate(p)] for p, _ in pages]
        longest = max((len(p) for p, _ in pages), default=0)
        if not longest:
            return cls({}, [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0])
        at = np.array([(i, k) for i, p in enumerate(rows) for k in range(len(p))])
        each = [np.unique(rows[i][k]) for i, k in at]
        block, feature = np.repeat(np.arange(len(at)), [len(e) for e in each]), np.concatenate(each)  # the ones of a sparse matrix
        y = np.array([v for _, labels in pages for v in labels])
        size = np.array([len(p) for p, _ in pages])
        live = np.arange(longest)[:, None] < size  # by place, then page
        gold = np.zeros((longest, len(pages)), int)
        gold[at[:, 1], at[:, 0]] = y
        pairs = np.zeros((2, 2))
        for k in range(1, longest):
            np.add.at(pairs, (gold[k - 1][live[k]], gold[k][live[k]]), 1)
        heads = np.bincount(gold[0][live[0]], minlength=2)
        w, t, f = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
        moments = [[np.zeros_like(a), np.zeros_like(a)] for a in (w, t, f)]
        for step in range(1, STEPS + 1):
            score = np.zeros((longest, len(pages), 2))
            score[at[:, 1], at[:, 0], 1] = np.bincount(block, w[feature], len(at))
            alpha, beta = np.zeros_like(score), np.zeros_like(score)
            alpha[0] = score[0] + f
            for k in range(1, longest):
                new = np.logaddexp(alpha[k - 1][:, :1] + t[0], alpha[k - 1][:, 1:] + t[1]) + score[k]
                alpha[k] = np.where(live[k][:, None], new, alpha[k - 1])
            for k in range(longest - 2, -1, -1):
                ahead = beta[k + 1] + score[k + 1]
                new = np.logaddexp(ahead[:, :1] + t[:, 0], ahead[:, 1:] + t[:, 1])
                beta[k] = np.where(live[k + 1][:, None], new, 0)
            z = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
            p = np.exp(alpha + beta - z[None, :, None])
            expected = np.zeros((2, 2))
            for k in range(1, longest):
                joint = np.exp(alpha[k - 1][:, :, None] + t + (score[k] + beta[k])[:, None, :] - z[:, None, None])
                expected += joint[live[k]].sum(0)
            grads = (np.bincount(feature, (y - p[at[:, 1], at[:, 0], 1])[block], len(names)), pairs - expected, heads - p[0][live[0]].sum(0))
            for a, g, m in zip((w, t, f), grads, moments, strict=True):
                g = g / len(y) - SHRINK * a / 10
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                a += RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        return cls({n: float(w[i]) for n, i in names.items()}, t.tolist(), f.tolist())

    def decode(self, page: list[Block]) -> list[int]:
        """The best sequence of labels (Viterbi)."""
        if not page:
            return []
        weight, (t0, t1) = self.weights.get, self.steps
        back: list[tuple[int, int]] = []
        a, b = self.first
        for k, block in enumerate(page):
            s = sum([weight(x, 0.0) for x in features(block, k, len(page))])
            if k:
                from0, from1 = int(b + t1[0] > a + t0[0]), int(b + t1[1] > a + t0[1])
                a, b = (b + t1[0] if from0 else a + t0[0]), (b + t1[1] if from1 else a + t0[1]) + s
                back.append((from0, from1))
            else:
                b += s
        out = [int(b > a)]
        for choice in reversed(back):
            out.append(choice[out[-1]])
        return out[::-1]


def train(pages: DataFrame, sample: int = SAMPLE, page_bytes: int = PAGE_BYTES) -> Field:
    """The field of `sample` pages at most, of page_bytes at most: those with the least hash of their page_id."""
    usable = pages.where("html is not null and page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where(F.octet_length("html") <= page_bytes)
    chosen = usable.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()  # ids alone go to the driver from each task
    ids = [x.page_id for x in chosen]
    rows = usable.where(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").collect() if ids else []
    return fitted([x.html for x in rows])


#: A page to train on in many frames where a table has none to train on (all are empty or too large).
USUAL = (
    "<html><head><title>A page</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav><article><h1>What the page is about</h1>"
    + "".join(f"<p>{x}</p>" for x in ("This is the first paragraph, of one sentence.", "A second one goes on for longer, with a clause, and another, before it ends. Then it says more.", "Short.", "The last paragraph closes what the others began, as such pages do; it is followed by a footer."))
    + "</article><footer>&copy; 2020 The site</footer></body></html>"
)


def fitted(sample: list[str]) -> Field:
    """The field of some pages: labelled by their structure where they have one, else by density; without any text, that of USUAL."""
    parsed = [blocks(x) for x in sample]
    said: dict[str, int] = {}
    for page in parsed:
        for text in {b.text for b in page}:
            said[text] = said.get(text, 0) + 1
    common = {text for text, n in said.items() if n > 1}
    labelled = []
    for k, page in enumerate(parsed):
        labels = structural_labels(page)
        labelled += variants(page, density_labels(page, common) if labels is None else labels, k)
    for k in range(0 if labelled else 40):
        page = blocks(USUAL)
        labelled += variants(page, structural_labels(page) or [], k)
    return Field.trained(labelled)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row: the article's blocks joined by line feeds.

    Null and empty html have an empty text; page_id and url may be null; repeated rows each give one; other
    columns are ignored; an empty table gives no rows.
    """
    ship(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(field or train(pages))  # as many weights as the sample has features

    def run(batches):
        f = model.value
        for b in batches:
            for rows, data, bounds in pieces(b, "html"):
                texts = []
                for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                    page = blocks(data[s:e].tobytes().decode())
                    texts.append("\n".join([x.text for x, y in zip(page, f.decode(page), strict=True) if y]))
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
