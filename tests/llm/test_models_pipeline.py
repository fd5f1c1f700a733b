"""Language identification, main-text extraction and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mobilis.llm import html_extract as hx
from mobilis.llm import lang_id as li
from mobilis.llm.html_blocks import blocks
from mobilis.llm.html_labelled import labelled_pages
from mobilis.llm.queries import op4_lang_id

SF = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = li.new_network(["a", "b", "c"], 3, 1)
    for name in ("inputs", "states", "outputs"):
        setattr(net, name, [p.astype(np.float64) for p in getattr(net, name)])
    net.bias = net.bias.astype(np.float64)
    x, y = rng.integers(0, 256, (4, 6)).astype(np.uint8), rng.integers(0, 3, 4)

    def loss():
        p = li.forward(net, x, np.ones(x.shape)).astype(np.float64)
        return -np.log(p[:, np.arange(4), y]).mean()
    for p, g in zip(net.parameters(), li._gradients(net, x, y, 3), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 1e-3
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert g[at] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=1e-5)


def test_windows_cover_texts_once():
    blobs = [b"", b"abc", b"x" * 9, b""]
    spans, mask, owner = li.windows(blobs, 4)
    assert mask.sum(axis=1).tolist() == [3, 4, 4, 1] and owner.tolist() == [1, 2, 2, 2]
    assert bytes(spans[0][:3]) == b"abc"


def test_held_out_accuracy(spark):
    out = op4_lang_id(spark, SF).join(spark.read.parquet(SF + "/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == 1000
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in out)


def test_lang_id_edges_and_positions(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["the", "and", "of"] if i % 2 else ["der", "und", "für"], k=40)), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !?", "en"), (103, "the and of " * 5000, None), (104, "the the and", None), (104, "the the and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    net = li.fit(df)
    out = sorted((r.doc_id, r.lang_pred) for r in li.lang_id(df, net).collect())
    assert out[60:63] == [(100, "und"), (101, "und"), (102, "und")] and out[63:] == [(103, "en"), (104, "en"), (104, "en")]
    labels = li.position_labels(net, b"the and of the and of the " * 4 + "der und für der und für ".encode() * 5)
    assert labels[:100].count("en") > 80 and labels[-100:].count("de") > 80 and li.position_labels(net, b"") == []
    assert li.fit(df.limit(0)) is None and li.fit(df.withColumn("lang", F.lit(None).cast("string"))) is None
    assert [r.lang_pred for r in li.lang_id(df.where("doc_id = 104"), None).collect()] == ["und", "und"]
    assert li.lang_id(df.limit(0), net).collect() == []


@pytest.fixture(scope="module")
def field():
    return hx.train()


def test_labelled_pages_have_one_label_per_block():
    for html, labels in labelled_pages(300, 5):
        assert len(blocks(html)) == len(labels)


def test_extraction_on_pages_not_trained_on(field):
    right = total = 0
    for html, labels in labelled_pages(300, 77):
        want = "\n\n".join(b.text for b, main in zip(blocks(html), labels, strict=True) if main)
        right += hx.main_text(html, field) == want
        total += 1
    assert right / total > 0.9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div class="cookie-notice">We use cookies.</div><header class="site-header">My Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<article><h1>The  title &amp; more</h1><p>First &eacute;t&#233; paragraph, with\n<b>bold</b><br>and a <a href="#">link</a> in it.
<p>Second paragraph, which is not closed and long enough to read like one, too.
<div class="ad">Buy now!</div><ul><li>One point here<li>Another point there</ul>
<form class="newsletter"><label>Your mail</label><button>Go</button></form>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this very much, thank you for the text.</p></div></section></article>
<aside class="sidebar"><p>Related things to read.</p></aside><footer>&copy; 2020 Someone</footer></body></html>"""


def test_extraction_of_a_whole_page(field):
    assert hx.main_text(PAGE, field).split("\n\n") == [
        "The title & more", "First été paragraph, with bold and a link in it.",
        "Second paragraph, which is not closed and long enough to read like one, too.", "One point here", "Another point there"]


def test_head_needs_no_end_tag(field):
    assert hx.main_text(PAGE.replace("</head>", ""), field) == hx.main_text(PAGE, field) != ""
    shown = lambda html: [b.text for b in blocks(html)]
    assert shown("<html><head><title>T</title><body><article><p>One<p>Two</article>") == ["One", "Two"]
    assert shown("<head><title>T</title><meta charset=x><link rel=y><script>s</script><style>t</style><noscript><p>n</p></noscript><p>One") == ["One"]
    assert shown("<head><title>T</title>\n<a href=x>One</a> two") == ["One two"] and shown("<head><title>T</title>One<p>Two") == ["One", "Two"]
    # A title without an end, and tags inside one that has an end.
    assert shown("<head><title>T<body><p>One<svg><title>x</title></svg>") == ["One"] and shown("<title>T<p>One") == ["One"]
    assert shown("<head><title>About <b> and <p> tags</title></head><body><p>One") == ["One"]


def test_extraction_edges(spark, field):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>"), (5, "u", "<script>never closed <p>x</p>"), (6, "u", "<b" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    out = hx.html_extract(df, field).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert sorted(r.n_chars for r in out)[:3] == [0, 0, 0] and sum(r.n_chars > 100 for r in out) == 2
    assert hx.html_extract(df.limit(0), field).collect() == []


def test_viterbi_equals_all_labellings():
    rng = np.random.default_rng(4)
    f = hx.Field({}, 0.3, [[0.5, -0.7], [-0.2, 0.4]])
    for n in range(1, 7):
        s = rng.normal(size=n).tolist()
        score = lambda y: f.start * y[0] + sum(a for a, b in zip(s, y, strict=True) if b) + sum(f.moves[a][b] for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        best = max(([bool(k >> i & 1) for i in range(n)] for k in range(2 ** n)), key=score)
        assert hx.viterbi(s, f) == best


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(SF + "/documents.parquet").where("doc_id < 300")
    rng = random.Random(6)
    w = [f"q{rng.random():.6f}" for _ in range(400)]
    extra = [(9001, " ".join(w[:100])), (9002, " ".join(w[:100])), (9003, " ".join(w[:99]) + " zzz"), (9004, "short"), (9005, " ".join(w[200:300])),
             (9006, " ".join(w[300:400] + w[220:290])), (9007, None), (9001, " ".join(w[:100]))]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in extra]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    columns, ids, after = docs.columns, [], docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = corpus_pipeline.stored(stage(spark, after, SF), "test-stage")
        assert after.columns == columns and after.dtypes == docs.dtypes, name
        ids.append(sorted(r.doc_id for r in after.where("doc_id >= 9000").collect()))
    assert ids[0] == [9001, 9001, 9002, 9003, 9005, 9006] and ids[1] == [9002, 9003, 9005, 9006] and ids[2] == [9002, 9005, 9006] == ids[3]
    cut = after.where("doc_id = 9006").first()
    assert cut.text.split() == w[300:400] and cut.n_chars == len(cut.text)
    packed = corpus_pipeline.packing(spark, after, SF)
    assert packed.select("doc_id").distinct().count() == after.count()


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(SF + "/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
