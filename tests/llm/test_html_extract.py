import re
import resource
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from reviewlake.llm.html_extract import STEPS, Tags, Vectors, blocks, extract, gradients, init, inputs, main_texts, probabilities, trained, training_set

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<div class="cookie-notice">We use cookies</div><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="ad">Buy now</div><article><h1>A &amp; B</h1><p><b>First   paragraph,\n with <i>inline</i> parts.<br><p>Second one, a good deal longer than the first, so that it reads like text.</p>
<!-- <p>hidden</p> --><ul><li>Point one of the list.</li><li>Point two of the list.</li></ul></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>Nice post!</p></div></section><form><label>Mail</label><input><button>Send</button></form>
<footer>&copy; example</footer></body></html>"""


def test_blocks():
    got = [(f"t:{p.tag}", text) for p, text, _ in blocks(PAGE)]
    assert ("t:h1", "A & B") in got and ("t:p", "Second one, a good deal longer than the first, so that it reads like text.") in got
    assert "First paragraph, with inline parts." in [t for _, t in got] and not any("hidden" in t or "no" == t for _, t in got)
    assert blocks("") == blocks("<p></p><!-- x") == [] and [t for _, t, _ in blocks("a < b &lt; c")] == ["a < b < c"]
    assert [t for _, t, _ in blocks("<p>a<td>b</div></p></x>c<script>never closed")] == ["a", "b", "c"]


def test_gradients_agree_with_differences():
    pages, labels = training_set(4, 1)
    w = {k: v.astype(np.float64) for k, v in init(3, 1).items()}
    grads = gradients(w, pages, labels)[1]
    rng = np.random.default_rng(0)
    for k in ("path", "word", "out", "bias", "xf", "hf", "xb", "hb"):
        ix = tuple(rng.integers(0, s) for s in w[k].shape)
        if k in ("path", "word"):
            ix = (int(pages[0][0][1][0] if k == "word" else pages[0][0][0].all_slots()[0]), 2)
        old, step = w[k][ix], 3e-3
        w[k][ix] = old + step
        up = gradients(w, pages, labels)[0]
        w[k][ix] = old - step
        down = gradients(w, pages, labels)[0]
        w[k][ix] = old
        assert abs((up - down) / 2 / step - grads[k][ix]) < 1e-3 * max(0.1, abs(grads[k][ix]))


def test_held_out_accuracy():
    pages, labels = training_set(80, 4242)
    w = trained()
    ok = [a for x, y in zip(pages, labels) for a in (probabilities(w, *inputs(w, [x]))[:, 0] > 0.5) == np.array(y)]
    assert np.mean(ok) > 0.98


def test_main_text_and_batches():
    w = trained()
    want = "A & B\nFirst paragraph, with inline parts.\nSecond one, a good deal longer than the first, so that it reads like text.\nPoint one of the list.\nPoint two of the list."
    got = main_texts(w, [PAGE, "", PAGE.replace("</article>", "<p>And a third paragraph.</p>" * 300 + "</article>")], Vectors(), width=2)
    assert got[0] == want and got[1] == "" and got[2] == want + "\nAnd a third paragraph." * 300


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<nav><a>x</a></nav>")], "page_id long, url string, html string").selectExpr("*", "7 AS text")
    got = sorted((r["page_id"] or 0, r["text"][:5], r["n_chars"] == len(r["text"])) for r in extract(df).collect())
    assert got[1:] == [(1, "A & B", True), (1, "A & B", True), (2, "", True), (3, "", True)]
    assert extract(df.limit(0)).count() == 0


TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S)


def test_tags_against_one_pattern():
    """The linear scanner finds what the plain pattern finds."""
    rng = np.random.default_rng(6)
    bits = ["<", "a", "<a ", "</p", ">", '"', "'", " ", "<!--", "-->", "<!", "x=", "<b", "/", "<p>", "-"]
    for _ in range(4000):
        page = "".join(rng.choice(bits, rng.integers(0, 24)))
        want = [(m.start(), m.end(), (m[2] or "").lower(), m[1] == "/", m[3] or "") for m in TOKEN.finditer(page)]
        assert list(Tags(page)) == want, page


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<!x " * 250_000, "<a '" * 250_000 + ">", '<a "x>' * 160_001, "<b>x" * 250_000, "<div>x" * 160_000, "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q{chr(97 + i // 676 % 26)}>x" for i in range(20_000)), "<b>" * 100_000 + "<h1>x" * 100_000, "<i>" * 100_000 + "</b>" * 100_000, "<p>some words here" * 100_000],
    ids=["unclosed", "declarations", "quotes", "odd quotes", "inline", "nested", "classes", "headings", "stray ends", "many blocks"],
)
def test_long_pages_take_linear_time_and_bounded_memory(page):
    w, before = trained(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    began = time.time()
    main_texts(w, [page, "<p>small</p>"] * 2, Vectors())
    assert time.time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # KB


def test_stretches_change_nothing():
    page = "<article>" + "<p>one more sentence of the text.</p><div class=ad>buy</div>" * STEPS + "</article>"
    w = trained()
    x, real = inputs(w, [[(p, np.array([1, 2]), [0.5] * 7) for p, _, _ in blocks(page)]])
    import reviewlake.llm.html_extract as module

    whole, module.STEPS = module.STEPS, len(x)
    try:
        want = probabilities(w, x, real)
    finally:
        module.STEPS = whole
    assert len(x) > 2 * STEPS - 1 and np.allclose(probabilities(w, x, real), want, atol=1e-5)


class Articles(HTMLParser):
    """Words inside of article elements of pages, as another parser reads them."""

    def __init__(self):
        super().__init__()
        self.depth, self.raw, self.words = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.raw += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.raw -= tag in ("script", "style")

    def handle_data(self, data):
        if self.depth > 0 and self.raw <= 0:
            self.words += data.split()


def test_pages_not_made_by_the_generator():
    """The given pages, against the words of their article elements."""
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    w, exact, compared = trained(), 0, 0
    for r, text in zip(rows, main_texts(w, [r["html"] or "" for r in rows], Vectors())):
        parser = Articles()
        parser.feed(r["html"] or "")
        if parser.words:
            compared += 1
            exact += text.split() == parser.words
    assert compared > 50 and exact >= 0.97 * compared
