import random

import numpy as np
import pytest

from treelift.llm.html_extract import N_KINDS, Model, _labels, extract, features, labelled_page, main_texts, parse, trained_model


def test_marginals_are_exact():
    rnd = np.random.default_rng(5)
    parents = np.array([-1, 0, 0, 1, 1, 2, 4, -1, 7])
    depths = np.array([0, 1, 1, 2, 2, 2, 3, 0, 1])
    kinds = rnd.integers(0, N_KINDS, 9)
    x = rnd.normal(size=(9, 4))
    model = Model(rnd.normal(size=4), rnd.normal(size=(N_KINDS, 2, 2)))
    total, node, joint = 0.0, np.zeros(9), np.zeros((9, 2, 2))
    for code in range(512):
        y = np.array([code >> k & 1 for k in range(9)])
        p = np.exp((x @ model.weights) @ y + sum(model.pairs[kinds[k], y[parents[k]], y[k]] for k in range(9) if parents[k] >= 0))
        total += p
        node += p * y
        for k in range(9):
            if parents[k] >= 0:
                joint[k, y[parents[k]], y[k]] += p
    got, pairs = model.infer(x, parents, kinds, depths)
    assert np.allclose(got, node / total)
    assert all(np.allclose(pairs[k], joint[k] / total) for k in range(9) if parents[k] >= 0)


def test_held_out_pages():
    rnd = random.Random(12345)
    right = total = 0
    for _ in range(150):
        tree = parse(labelled_page(rnd))
        p = trained_model().marginals(*features([tree])) >= 0.5
        for k, y in enumerate(_labels(tree)):
            if tree.text[k]:
                total += 1
                right += p[k] == y
    assert right / total > 0.98


ARTICLE = "<h1>A title that\n says much</h1><p><b>First  paragraph with &amp; and &eacute;, long enough to be read.<br><p>Second <a href=/x>linked</a> paragraph, which is also here.</p>"
WANT = "A title that says much\nFirst paragraph with & and é, long enough to be read.\nSecond linked paragraph, which is also here."
NOISE = {
    "nav": "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>",
    "header": "<header><h1>Site name</h1><ul><li><a href=/a>Start</a></li></ul></header>",
    "footer": "<footer>&copy; example.org &middot; All rights reserved.</footer>",
    "ad": '<div class="ad">Buy this now, it is cheap and good.</div>',
    "aside": '<aside class="sidebar"><h3>Related</h3><ul><li><a href=/c>Other story</a></li></ul></aside>',
    "form": "<form><label>Search</label><input name=q><button>Go</button></form>",
    "notice": '<div class="cookie-notice"><p>We use cookies on this site.</p><a href=/ok>Accept</a></div>',
    "comments": '<section id="comments"><h3>Comments</h3><div>Ann: I liked this text very much, thank you for it.</div><div>Bob: So did I, and would read more.</div></section>',
    "script": "<script>var t=\"</p>\";track(1);</script><style>p{margin:0}</style><!-- a comment <p>no</p> -->",
}


@pytest.mark.parametrize("name", NOISE)
@pytest.mark.parametrize("holder", ["article", "main", 'div id="content"'])
def test_noise_goes(name, holder):
    end = holder.split()[0]
    for page in (f"{NOISE[name]}<{holder}>{ARTICLE}</{end}>", f"<{holder}>{ARTICLE}</{end}>{NOISE[name]}"):
        page = f"<!DOCTYPE html><html><head><title>no</title></head><body>{NOISE['nav']}{page}{NOISE['footer']}</body></html>"
        assert extract([page], trained_model()) == [WANT]


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p"), (4, "u", "<>&<"), (4, "u", "</p></div></x><script>x"), (5, "u", "<div>" * 300 + "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = main_texts(pages).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert main_texts(pages.limit(0)).count() == 0
    long = "<article>" + "<p>word and word, again.</p>" * 5000 + "</article>"
    assert extract([long], trained_model())[0].count("\n") == 4999
