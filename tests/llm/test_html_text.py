import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.llm import html_text as ht
from pluvia.llm.bilstm import BiLstm
from pluvia.llm.html_blocks import Block, blocks_of
from pluvia.llm.shared import drawn
from tests.llm.helpers import sentence


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return ht.trained([article_page(rng) for _ in range(40)], steps=200)


def article_page(rng, n=4):
    body = "".join(f"<p>{sentence(rng, 30)}.</p>" for _ in range(n))
    menu = "".join(f'<li><a href="/x">{sentence(rng, 1)}</a></li>' for _ in range(5))
    return (
        f"<html><head><title>{sentence(rng, 4)}</title></head><body><nav><ul>{menu}</ul></nav>"
        f'<div class="ad">{sentence(rng, 12)}</div><article><h1>{sentence(rng, 6)}</h1>{body}</article>'
        f"<footer>&copy; {sentence(rng, 9)}</footer></body></html>"
    )


def texts(page):
    return [b.text for b in blocks_of(page)]


@pytest.mark.parametrize(
    "page,want",
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<b>b</b>c<br>d</p>e", ["abc d", "e"]),
        ("<p>one<p>two<div>three", ["one", "two", "three"]),
        ("<p><b>open<br><p>next</p>", ["open", "next"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
        ("<script>var t='</p>';</script>x<style>p{}</style>", ["x"]),
        ("<script>never ends", []),
        ("<!-- <p>no</p> -->yes<!-- open", ["yes"]),
        ("a < b &lt;c&gt; &#233;&nbsp;&#x41; &a", ["a < b <c> é A &a"]),
        ('<p title="a > b">x</p>', ["x"]),
        ("<P CLASS=Big>x</P></div></span>y", ["x", "y"]),
        ("<p>broken <a href='x", ["broken <a href='x"]),
        (" \n\t ", []),
        ("&am<b>p;</b>", ["&amp;"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_and_links():
    page = '<body><div id="side-bar" class="Ad x"><ul><li><a href=u>link</a> rest</li></ul></div></body>'
    assert blocks_of(page) == [Block(("body", "div side bar ad x", "ul", "li"), "link rest", 4)]


def test_gradients():
    rng = np.random.default_rng(0)
    net = BiLstm(3, 2, 1)
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    x, mask = rng.normal(size=(5, 3, 3)), np.arange(5)[:, None] < np.array([5, 2, 3])
    y = rng.integers(0, 2, (5, 3)).astype("f8")
    _, grads = net.gradients(x, mask, y)
    for name, value in net.p.items():
        for at in list(np.ndindex(value.shape))[:6]:
            old, losses = value[at], []
            for step in (1e-3, -1e-3):
                value[at] = old + step
                losses.append(net.gradients(x, mask, y)[0])
            value[at] = old
            assert abs((losses[0] - losses[1]) / 2e-3 - grads[name][at]) < 2e-3


def test_padding_does_not_matter(model):
    rng = random.Random(9)
    pages = [blocks_of(article_page(rng, n)) for n in (1, 3, 30)] + [[]]
    together = ht.main_marks(model, pages)
    for page, marks in zip(pages, together):
        assert (ht.main_marks(model, [page])[0] == marks).all()


def test_held_out_layouts(model):
    rng = random.Random(77)
    made = ht.Layouts([sentence(rng, 200, 5000) for _ in range(30)], seed=123)
    right = total = 0
    for _ in range(150):
        blocks, marks = made.page()
        if blocks:
            found = ht.main_marks(model, [blocks])[0]
            right += int((found == np.array(marks)).sum())
            total += len(marks)
    assert right / total > 0.97


def test_articles_are_found_whole(spark, model):
    rng = random.Random(5)
    pages = [(i, "u", article_page(rng, rng.randint(1, 12)), "t", "n") for i in range(40)]
    pages += [(100, None, None, "t", "n"), (None, "u", "", "t", "n"), (101, "u", "<p></p>", "t", "n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, found string")
    got = {r.page_id: r for r in ht.extract(df, model).collect()}
    assert len(got) == len(pages)
    for i, _, page, *_ in pages:
        inside = [b.text for b in blocks_of(page or "") if "article" in b.path]
        assert got[i].text == "\n\n".join(inside)
        assert got[i].n_chars == len(got[i].text)


def test_fit_and_empty_table(spark):
    rng = random.Random(6)
    schema = "page_id long, url string, html string"
    empty = spark.createDataFrame([], schema)
    assert ht.extract(empty, ht.BiLstm(ht.PATH_SIZE + ht.WORD_SIZE + ht.SIZES, 2)).count() == 0
    assert ht.trained([], steps=2).predict(np.zeros((1, 1, 230), "f4"), np.ones((1, 1), bool)).shape
    few = spark.createDataFrame([(i, "u", article_page(rng)) for i in range(30)], schema)
    one, two = ht.fit(few), ht.fit(few.repartition(3))
    assert all((one.p[k] == two.p[k]).all() for k in one.p)


@pytest.mark.parametrize(
    "page,want",
    [
        ('<div><svg class="i"/>icon</div><p>article</p>', ["icon", "article"]),
        ("<p>a <math/>b</p><p>c <svg><path d='x'/><text>no</text></svg>d</p>", ["a b", "c d"]),
        ("<svg/><p>one</p><svg><title>no</title></svg><p>two</p>", ["one", "two"]),
        ("<svg><svg>no</svg>no</svg>yes", ["yes"]),
        ("<div><svg><g>no</div><p>article</p>", ["article"]),
        ("<div><noscript>no<div>no</div></div><p>article</p>", ["article"]),
        ("<div><noscript>no</div><p>one</p><noscript>no</noscript>two", ["one", "two"]),
        ("<noscript><!-- no </noscript>yes", ["yes"]),
        ("<div><iframe src=x></div>yes<iframe>no</iframe>", ["yes"]),
        ("<div><template><p>no</p></template>yes</div>", ["yes"]),
        ("<p>out <template><p>no</p></template> more</p>", ["out more"]),
        ("<head><title>no</head><body><p>yes</p>", ["yes"]),
        ("<div><script>var t='</div>';no", []),
        ("<script>w('<script src=' + x)</script>yes", ["yes"]),
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn><mspace/></math> then</p>", ["if x=2 then"]),
        ("<p>see <object data=u><param name=a>the text</object> here</p>", ["see the text here"]),
        ("<div><object><p>fallback</p></div><p>article</p>", ["fallback", "article"]),
    ],
)
def test_skipped_elements_end(page, want):
    assert texts(page) == want


@pytest.mark.parametrize(
    "page,n_blocks",
    [
        ("<a " * 300_000, 1),  # tags that never end
        ('<a href="x' * 100_000, 1),
        (("<a '" + '<b "') * 100_000 + ">", 1),
        ("<!x" * 300_000, 1),
        ("<title>" * 100_000, 0),
        ("<title>x" + "</title " * 100_000, 0),
        ("<div>x" * 100_000, 100_000),  # elements that stay open
        ("".join(f"<div class=c{i}>x" for i in range(30_000)), 30_000),
    ],
)
def test_broken_and_very_long_pages_take_time_and_memory_in_proportion(page, n_blocks):
    tracemalloc.start()
    start = time.process_time()
    found = blocks_of(page)
    took, most = time.process_time() - start, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == n_blocks and took < 60 and most < 300e6
    assert max((len(b.path) for b in found), default=0) <= 512


def test_quotes_that_hide_the_end_of_a_tag():
    texts = lambda page: [b.text for b in blocks_of(page)]
    assert texts("<p title='a > b'>x</p>y") == ["x", "y"]
    assert texts('<p title="it\'s > 1">x') == ["x"]
    assert texts("<p title='open>x</p>") == ["<p title='open>x"]
    assert texts('1 < 2 <b>3</b> "4" > 5') == ['1 < 2 3 "4" > 5']


def test_samples_of_tables_of_any_size(spark):
    """The share of a bounded sample of ten thousand million rows draws about as many as it should."""
    places = spark.range(1_000_000).select(F.xxhash64("id").alias("place"))
    for share in (0.3, 0.0123, 1e-4, 1.0):
        n = places.filter(drawn(F.col("place"), F.lit(share))).count()
        assert abs(n - 1e6 * share) <= 5 * (1e6 * share) ** 0.5 * (share < 1)
    # all in the first millionth: a finer share takes its part of them
    near = spark.range(4000).select((F.expr(f"id * {1 << 50} div 1000000 * 1000000")).alias("place"))
    assert 3200 < near.filter(drawn(F.col("place"), F.lit(2e-7))).count() < 3350
    assert near.filter(drawn(F.col("place"), F.lit(0.0))).count() == 0
