"""Main text of web pages: a recurrent labeller over the blocks of a page.

Each leaf block is a vector of its tag path (hashed names of its elements and of their classes), its
hashed words and a few sizes. A bidirectional LSTM reads the blocks of a page in order and says for each
whether it belongs to the article. It is trained here, on layouts made from the blocks of a bounded
sample of the pages: the sampled pages as they are, where they name their article, and their texts
dealt anew into articles, menus, notices, adverts, forms, comments and footers.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.bilstm import BiLstm
from pluvia.llm.html_blocks import Block, blocks_of
from pluvia.llm.shared import drawn, text_of
from pluvia.llm.shingles import word_hashes

PATH_SIZE, WORD_SIZE, SIZES = 192, 32, 6
HIDDEN = 16
#: Pages from which the labeller is trained, about, and how often it sees a batch of layouts.
SAMPLE_PAGES = 200
#: Sampled pages are at most so long, and train as they are up to so many blocks: a page of the sample is
#: driver memory, and long pages would fill the batches. Pages of any length are extracted.
SAMPLE_CHARS, SAMPLE_BLOCKS = 50_000, 80
STEPS = 350
BATCH = 24
#: Blocks and padding scored at once.
SCORED = 20_000
INSIDE = frozenset(["article", "main"])
OUTSIDE = frozenset("nav header footer aside form button select menu dialog".split())


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Marks the names on the way to a block; those of its last two elements apart as well."""
    x = np.zeros(PATH_SIZE, "f4")
    for depth, label in enumerate(path):
        for name in label.split():
            x[zlib.crc32(name.encode()) % PATH_SIZE] = 1
            if depth >= len(path) - 2:
                x[zlib.crc32(f"{name}/{len(path) - depth}".encode()) % PATH_SIZE] = 1
    return x


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """The vectors of all blocks of the pages, one after the other."""
    blocks = [b for page in pages for b in page]
    x = np.zeros((len(blocks), PATH_SIZE + WORD_SIZE + SIZES), "f4")
    if not blocks:
        return x
    known: dict[tuple[str, ...], np.ndarray] = {}
    for i, b in enumerate(blocks):
        if b.path not in known:
            known[b.path] = path_vector(b.path)
        x[i, :PATH_SIZE] = known[b.path]
    texts = [b.text.encode("utf-8", "replace") for b in blocks]
    hashes, starts = word_hashes(np.frombuffer(b" ".join(texts), np.uint8))
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    slot = (hashes % np.uint64(WORD_SIZE)).astype(int)
    words = np.bincount(of * WORD_SIZE + slot, minlength=len(blocks) * WORD_SIZE)
    words = words.reshape(-1, WORD_SIZE)
    n = words.sum(axis=1)
    x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = words / np.maximum(n, 1)[:, None]
    chars = np.array([len(b.text) for b in blocks])
    place = np.concatenate([np.arange(len(p)) / max(len(p), 1) for p in pages])
    x[:, -SIZES:] = np.stack(
        [
            np.log1p(n) / 5,
            np.log1p(chars) / 8,
            np.array([b.linked for b in blocks]) / np.maximum(chars, 1),
            n < 4,
            place,
            np.array([b.text[-1] in ".!?:" for b in blocks]),
        ],
        axis=1,
    )
    return x


def padded(x: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors by time and page, with the mask of those that are there."""
    out = np.zeros((max(sizes), len(sizes), x.shape[1]), "f4")
    mask = np.arange(max(sizes))[:, None] < np.array(sizes)
    start = 0
    for i, n in enumerate(sizes):
        out[:n, i] = x[start : start + n]
        start += n
    return out, mask


def batches_by_size(sizes: list[int]) -> Iterator[list[int]]:
    """Numbers of pages of like size, so many that padding included ``SCORED`` blocks meet."""
    group: list[int] = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if sizes[i] == 0:
            continue
        if group and sizes[i] * (len(group) + 1) > SCORED:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def main_marks(model: BiLstm, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page which of its blocks belong to the article."""
    sizes = list(map(len, pages))
    marks = [np.zeros(n, bool) for n in sizes]
    for group in batches_by_size(sizes):
        x = vectors([pages[i] for i in group])
        probability = model.predict(*padded(x, [sizes[i] for i in group]))
        for k, i in enumerate(group):
            marks[i] = probability[: sizes[i], k] > 0.5
    return marks


def named_article(blocks: list[Block]) -> list[bool] | None:
    """The article where the page itself names it by an element; null where it does not."""
    tags = [{label.split()[0] for label in b.path} for b in blocks]
    if not any(t & INSIDE for t in tags):
        return None
    noise = [set(" ".join(b.path).split()) & NOISE for b in blocks]
    return [bool(t & INSIDE) and not t & OUTSIDE and not n for t, n in zip(tags, noise)]


# Names that pages give to their parts, for the made layouts.
ARTICLE_NAMES = "content post entry story body text main article page single prose copy".split()
PARTS = {
    "menu": "nav navbar menu breadcrumb breadcrumbs navigation tabs toolbar".split(),
    "header": "header masthead top banner branding".split(),
    "footer": "footer bottom copyright legal colophon".split(),
    "sidebar": "sidebar widget related aside trending recommended popular".split(),
    "advert": "ad ads advert advertisement sponsored promo sponsor".split(),
    "notice": "cookie consent notice alert gdpr popup modal newsletter subscribe".split(),
    "form": "form search login signup contact".split(),
    "comments": "comment comments reply replies discussion thread respond".split(),
    "share": "share social tags meta byline toc".split(),
}
NOISE = frozenset(name for names in PARTS.values() for name in names)
SHORT = (
    "Home|About|Contact|Privacy policy|Terms of use|Log in|Subscribe|Search|Read more|Share|Reply|Next|"
    "Accept all cookies|We use cookies.|Advertisement|All rights reserved.|Leave a comment|Menu"
).split("|")


class Layouts:
    """Makes labelled pages from texts of pages."""

    def __init__(self, texts: list[str], seed: int):
        self.random = random.Random(seed)
        self.texts = texts or list(SHORT)

    def text(self, short: bool = False) -> str:
        r = self.random
        if short and r.random() < 0.5:
            return r.choice(SHORT)
        words = r.choice(self.texts).split()
        n = r.randint(1, 6) if short else r.choice([r.randint(1, 12), r.randint(8, 80), 200])
        at = r.randrange(max(1, len(words) - n + 1))
        return " ".join(words[at : at + n])

    def named(self, tag: str, names: list[str], certain: bool = False) -> str:
        """An element, named in its tag, class or id."""
        r = self.random
        chosen = r.sample(names, min(len(names), r.choice([1, 1, 2])))
        if not certain and r.random() < 0.35:
            return tag
        return " ".join([tag, *chosen])

    def part(self, kind: str, around: tuple[str, ...]) -> list[tuple[Block, bool]]:
        r, names = self.random, PARTS[kind]
        own = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
        if kind in own and r.random() < 0.6:
            root = self.named(own[kind], names)
        else:
            root = self.named(r.choice(["div", "div", "section", "ul", "aside"]), names, certain=True)
        made = []
        for _ in range(r.choice([1, 2, 4, 8]) if kind in ("menu", "comments", "sidebar") else r.choice([1, 1, 2, 3])):
            short = kind in ("menu", "form", "share", "header") or r.random() < 0.4
            inner = r.choice(
                {
                    "menu": [("ul", "li", "a"), ("li", "a"), ("a",), ("div", "a")],
                    "form": [("label",), ("p",), ("button",), ("div", "label"), ()],
                    "comments": [("div comment", "p"), ("p",), ("li", "p"), ("article comment", "p"), ("h3",)],
                }.get(kind, [(), ("p",), ("div",), ("li", "a"), ("span",), ("h3",), ("p", "a")])
            )
            text = self.text(short)
            linked = len(text) if "a" in inner else 0
            path = tuple(x for x in (*around, root, *inner))
            made.append((Block(path, text, linked), False))
        return made

    def article(self, around: tuple[str, ...]) -> list[tuple[Block, bool]]:
        r = self.random
        root = r.choice(
            [
                ("article",), (self.named("article", ARTICLE_NAMES),), ("main",), ("main", "article"),
                (self.named("div", ARTICLE_NAMES, True),), (self.named("section", ARTICLE_NAMES, True),),
                ("div", self.named("div", ARTICLE_NAMES)), (),
            ]
        )
        made = [(Block((*around, *root, r.choice(["h1", "h2"])), self.text(), 0), True)] * (r.random() < 0.85)
        for _ in range(r.choice([1, 2, 5, 10, 20])):
            inner = r.choice(
                [("p",)] * 8
                + [("p", "b"), ("p", "a"), ("h2",), ("h3",), ("ul", "li"), ("ol", "li"), ("blockquote", "p"),
                   ("pre",), ("table", "tr", "td"), ("figure", "figcaption"), ("div",), ("div", "p")]
            )
            text = self.text(short=inner[-1] in ("h2", "h3", "li", "td") and r.random() < 0.5)
            linked = r.randint(0, len(text)) if "a" in inner else 0
            made.append((Block((*around, *root, *inner), text, linked), True))
            if r.random() < 0.06:
                made += self.part(r.choice(["advert", "share", "sidebar", "form", "notice"]), (*around, *root))
        if r.random() < 0.15:
            made += self.part("comments", (*around, *root))
        return made

    def page(self) -> tuple[list[Block], list[bool]]:
        r = self.random
        around = r.choice([("html", "body"), ("html", "body"), ("html", "body", "div"), ("body",), ()])
        made: list[tuple[Block, bool]] = []
        for kind in ("notice", "header", "menu", "advert", "form", "sidebar", "share"):
            if r.random() < (0.75 if kind == "menu" else 0.35):
                made += self.part(kind, around)
        if r.random() < 0.97:
            made += self.article(around)
        for kind in ("share", "comments", "sidebar", "advert", "form", "notice", "menu", "footer"):
            if r.random() < (0.7 if kind == "footer" else 0.3):
                made += self.part(kind, around)
        return [b for b, _ in made], [y for _, y in made]


def trained(sample: list[str], steps: int = STEPS, seed: int = 7) -> BiLstm:
    """A labeller from the html of sampled pages. Equal samples give equal labellers."""
    rng = random.Random(seed)
    parsed = [blocks_of(page) for page in sample]
    own = [(b, y) for b in parsed if b and len(b) <= SAMPLE_BLOCKS and (y := named_article(b)) is not None]
    layouts = Layouts([b.text for page in parsed for b in page], seed)
    model = BiLstm(PATH_SIZE + WORD_SIZE + SIZES, HIDDEN, seed)

    def batches():
        for _ in range(steps):
            pages = [layouts.page() for _ in range(BATCH - (BATCH // 4 if own else 0))]
            pages += rng.choices(own, k=BATCH // 4) if own else []
            pages = [(b, y) for b, y in pages if b]
            x, mask = padded(vectors([b for b, _ in pages]), [len(b) for b, _ in pages])
            y = np.zeros(mask.shape, "f4")
            for i, (_, marks) in enumerate(pages):
                y[: len(marks), i] = marks
            yield x, mask, y

    model.fit(batches())
    return model


def fit(
    pages: DataFrame, page_id: str = "page_id", html: str = "html", sample_pages: int = SAMPLE_PAGES
) -> BiLstm:
    """A labeller trained on about ``sample_pages`` pages with html, chosen by a hash of the row; the
    driver gets these and no more than twice as many. Pages longer than ``SAMPLE_CHARS`` are not drawn,
    and those of more than ``SAMPLE_BLOCKS`` blocks give their texts to the made layouts only."""
    rows = pages.filter(F.length(F.col(f"`{html}`")).between(1, SAMPLE_CHARS)).select(
        F.xxhash64(F.col(f"`{page_id}`"), F.col(f"`{html}`")).alias("place"),
        F.col(f"`{html}`").alias("html"),
    )
    share = F.lit(min(1.0, sample_pages / max(rows.count(), 1)))
    chosen = rows.filter(drawn(F.col("place"), share)).limit(2 * sample_pages).collect()
    return trained([r["html"] for r in sorted(chosen, key=lambda r: (r["place"], r["html"]))])


def extract(
    pages: DataFrame, model: BiLstm, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row: the blocks of its article, in order, two line feeds
    between them.

    Null or empty html, and pages without an article, give an empty text. Character references are
    decoded, white space inside a block becomes one space. Nothing is cut, however long a page is;
    broken markup is read as browsers do. Equal html gives equal text up to batches: a page's marks
    don't depend on the pages scored with it. An empty table gives an empty result; other columns are
    ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("text string, n_chars long")
    def article(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts: list[str] = []
            for start in range(0, len(series), 200):
                parsed = [blocks_of(page) for page in series.iloc[start : start + 200]]
                for blocks, marks in zip(parsed, main_marks(shared.value, parsed)):
                    texts.append("\n\n".join(b.text for b, m in zip(blocks, marks) if m))
            yield pd.DataFrame({"text": texts, "n_chars": list(map(len, texts))})

    return pages.select(
        F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"),
        article(text_of(html)).alias("found"),
    ).select("page_id", "url", "found.*")
