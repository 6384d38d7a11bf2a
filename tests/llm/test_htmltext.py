import pytest

from sessionloom.llm import htmltext as ht
from sessionloom.llm.pagemaker import labelled_pages


def test_blocks_of_broken_markup():
    page = """<!-- <p>no</p> --><title>t</title><script>var a="</p><p>x";</script><div class="Foo-bar"><p>one <b>t&amp;w<i>o</i><br>three<p>four&nbsp;five
    <ul><li>a<li><a href="x>y">b</a></ul><img alt="<p>">six</div></p>sev<b>en</b> & &lt;p&gt;<style>q</style>nine<p"""
    assert [b.text for b in ht.blocks(page)] == ["one t&wo three", "four five", "a", "b", "six", "seven & <p>", "nine"]
    assert ht.blocks(None) == ht.blocks("") == ht.blocks(" <b> </b>") == []
    assert [b.text for b in ht.blocks("<a" * 3000)] == ["<a" * 2999]
    assert ht.blocks("x" * 300_000 + "<p>y")[1].text == "y"


CLOSING = "The closing paragraph of it, with words."
OPENING = "<h1>Title here</h1><p>First words of the article, which go on.</p>"


@pytest.mark.parametrize(
    "broken",
    ["<svg><path d='M0'>", "<div><svg><title>icon</title></div>", "<select><option>a<option>b", "<form><select><option>a</form>", "<div><object data=x></div>", "<object data=x>", "<div><video src=y></div>", "<p>"],
)
def test_an_element_that_is_not_closed_does_not_swallow_the_article(broken):
    page = f"<body><nav><a href=/>Home</a></nav><article>{OPENING}{broken}<p>{CLOSING}</p></article><footer>&copy; x</footer>"
    assert ht.main_text(page, ht.default_model()) == f"Title here First words of the article, which go on. {CLOSING}"


def test_formulas_and_embedded_things_are_read():
    page = "<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> here.</p></article>"
    assert ht.main_text(page, ht.default_model()) == "Energy is E=mc2 here."
    for tag in ("noscript", "video", "object", "canvas"):
        assert [b.text for b in ht.blocks(f"<p>a</p><{tag}><p>b</p></{tag}>c")] == ["a", "b", "c"]


@pytest.mark.parametrize("page", ["<body><div><p>{}</p></div></body>", "<p>{}", "<html><body><section><p>{}</section>", "<table><tr><td><p>{}</table>", "<nav><ul><li><a href=/>Home</a></ul></nav><div><p>{}</p></div>"])
def test_pages_without_an_article_element_give_their_text(page):
    text = "This is a long paragraph of text that says something, at length, about energy and work."
    assert ht.main_text(page.format(text), ht.default_model()) == text


def test_held_out_accuracy():
    model = ht.default_model()
    right = total = exact = 0
    pages = labelled_pages(150, 999)
    for page, main in pages:
        found = ht.blocks(page)
        want = [int(b.text in main) for b in found]
        got = model.decode(ht.features(found))
        right += sum(a == b for a, b in zip(want, got))
        total += len(want)
        exact += want == got
    assert right >= 0.98 * total and exact >= 0.8 * len(pages)


def test_viterbi_is_the_best_of_all_labellings():
    import itertools

    import numpy as np

    r = np.random.default_rng(0)
    names = {f"f{i}": i for i in range(5)}
    for _ in range(30):
        m = ht.Crf(names, r.normal(size=(5, 2)), r.normal(size=(2, 2)))
        rows = [[f"f{r.integers(5)}", f"f{r.integers(5)}"] for _ in range(6)]

        def value(y):
            return sum(m.weights[names[f], k] for row, k in zip(rows, y) for f in row) + sum(m.step[a, b] for a, b in zip(y, y[1:]))

        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert value(m.decode(rows)) == pytest.approx(value(best))


def test_query_shape(spark):
    page = '<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Title here</h1><p>Some  text of\nthe article, which is long enough.<p>More &eacute; text.</article><div class="comments"><p>First! I like this article, it is great.</p></div><footer>&copy; x</footer>'
    rows = [(1, "u", page, 1), (2, None, None, 1), (3, "v", "", 1), (None, "w", page, 1), (1, "u", page, 1)]
    got = ht.extract_main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    want = "Title here Some text of the article, which is long enough. More é text."
    assert sorted((x.page_id or 0, x.url, x.text, x.n_chars) for x in got if x.url) == sorted([(1, "u", want, len(want))] * 2 + [(3, "v", "", 0), (0, "w", want, len(want))])
    assert [x.text for x in got if x.page_id == 2] == [""]
    assert ht.extract_main_text(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
