"""URL filter, HTML text and neighbour search: brute force and odd inputs."""

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hilbert_ann, html_text
from millrace.llm.oracles import ORACLE_SQL
from millrace.llm.queries import QUERIES
from tests.oracle import compare, connect

URLS = [None, "", "no scheme", "http://A.B.Example.ORG/es/1?x", "https://example.org/en/12#t", "http://x.com/fr/a", "http://x.com/de", "http://com/de/", "a://b://c/d", "http://Ünï.net?q/../", "http://www.spam.net/a", "http://www.spam.net/a"]


def pages(spark, rows=None):
    rows = [(i, u, None, "x") for i, u in enumerate(URLS)] if rows is None else rows
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


def test_odd_urls(spark, folder):
    labels = spark.createDataFrame([(10, 0, 0), (11, None, 1), (3, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    d = folder(pages=pages(spark), labels=labels)
    assert compare(spark, QUERIES["op8_url_filter"], ORACLE_SQL["op8_url_filter"], d) == []
    got = {r.page_id: r for r in QUERIES["op8_url_filter"](spark, d).collect()}
    assert (got[0].host, got[0].path, got[0].rule) == ("", "", None)
    assert (got[3].host, got[3].rule, got[3].verdict) == ("a.b.example.org", "example.org/es/", "block")
    assert got[4].rule == "example.org/en/1" and got[5].verdict == "allow" and got[6].rule is None and got[7].rule == "com/de/"


def test_empty_pages(spark, folder):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = folder(pages=pages(spark, []), labels=labels)
    assert QUERIES["op8_url_filter"](spark, d).count() == QUERIES["op9_html_text"](spark, d).count() == 0


def test_bad_hosts_are_blocked(spark):
    from millrace.llm.url_filter import judge_urls

    rows = [(i, f"http://{'bad' if i < 40 else 'good'}.example.net/{i}", None, "") for i in range(120)]
    outcomes = spark.createDataFrame([(i, i < 40) for i in range(100)], "page_id long, bad boolean")
    got = {r.page_id: r.verdict for r in judge_urls(pages(spark, rows), outcomes, [], threshold=0.5).collect()}
    assert {got[i] for i in range(40)} == {"block"} and {got[i] for i in range(40, 120)} == {"allow"}


def test_articles_of_the_test_pages(spark, sf):
    raw = dict(connect(sf).sql("SELECT page_id, html FROM pages").fetchall())
    for r in QUERIES["op9_html_text"](spark, sf).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", raw[r.page_id], re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", article.replace("<br>", " "))]
        assert r.text == "\n\n".join(x for x in want if x) and r.n_chars == len(r.text)


def test_markup(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav><a>menu</a></nav><script>var a='<p>no</p>'</script><div class='cookie-notice'>accept</div>"
        "<main><h1>A &amp; B&nbsp;&#x43;</h1><p>one\n two<br>three<p>four <b>five</b> six<!-- gone <p> --><aside>side</aside><section id=comments><p>first!</section><form>f</form></main><footer>end</footer></body>"
    )
    assert html_text.lines_of(page) == (["A & B C", "one two three", "four five six"], True)
    assert html_text.lines_of(None) == ([], False) == html_text.lines_of("")
    assert html_text.lines_of("<p>cut <b") == (["cut <b"], False)


def test_marked_text_within_elements_named_beside_it():
    """A wrapper's name does not take the article along, nor an article header's its title."""
    inner = "<header class='entry-header'><div class='share'>tell</div><h1>Title</h1></header><p>text</p><div class='ad'><h2>buy</h2></div><section id='comments'><article><h3>re</h3>first!</article></section>"
    want = (["Title", "text"], True)
    for around in ("content-sidebar-wrap", "layout has-sidebar", "page-with-ads", "page"):
        assert html_text.lines_of(f"<div class='{around}'><p>beside</p><article>{inner}</article></div><p>more</p>") == want, around
        assert html_text.lines_of(f"<div class='{around}'><main>{inner}</main><div class='sidebar'>side</div></div>") == want, around
    assert html_text.lines_of(f"<form><div class='sidebar'><div role='main'>{inner}</div></div></form>") == want
    # articles of comments, of asides and of sidebars are not the page's
    for beside in ("<div id='comments'><article>no</article></div>", "<ol class='comment-list'><article>no</article></ol>", "<aside><article>no</article></aside>", "<div class='sidebar'><article>no</article></div>"):
        assert html_text.lines_of(f"<div><p>text</p></div>{beside}") == (["text"], False), beside


def test_template_lines_go(spark):
    body = "<div>Welcome</div><p>{0} a</p><p>{0} b</p><p>{0} c</p><div>Imprint</div>"
    rows = [(i, f"http://h.net/n/{i}", body.format(i), "x") for i in range(6)] + [(9, "http://other.net/n/1", body.format(9), "x"), (10, None, None, None)]
    rows += [(20, "http://copy.net/a", body.format("same"), ""), (21, "http://copy.net/b", body.format("same"), "")]
    got = {r.page_id: r.text for r in html_text.extract_text(pages(spark, rows)).collect()}
    assert all(got[i] == f"{i} a\n\n{i} b\n\n{i} c" for i in range(6))
    assert got[9].startswith("Welcome") and got[10] == "" and got[20] == got[21] and got[20].startswith("Welcome")


def test_marked_pages_are_differenced(spark):
    """Neighbours share a label that no name tells from the article: it goes, and paragraphs that they share stay."""
    body = "<div>Welcome</div><article><div>Tell a friend</div><h1>Title {0}</h1><p>{0} a</p><p>Free to copy.</p><div>Was this page useful?</div></article>"
    rows = [(i, f"http://h.net/n/{i}", body.format(i), "x") for i in range(5)] * 2 + [(9, "http://other.net/n/1", body.format(9), "x")]
    rows += [(20 + i, f"http://bare.net/{i}", f"<main><div>text {i}</div><div>Free to copy.</div></main>", "x") for i in range(3)]
    got = sorted((r.page_id, r.text) for r in html_text.extract_text(pages(spark, rows)).collect())
    want = [(i, f"Title {i}\n\n{i} a\n\nFree to copy.") for i in range(5) for _ in range(2)]
    want += [(9, "Tell a friend\n\nTitle 9\n\n9 a\n\nFree to copy.\n\nWas this page useful?")]
    assert got == want + [(20 + i, f"text {i}\n\nFree to copy.") for i in range(3)]


def test_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 5, rng.integers(0, 12))] for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert len(html_text.shared_lines(a, b)) == best[-1, -1]


def test_registered_domains(spark):
    from millrace.llm.url_filter import domain_of, suffix_of

    want = {
        "a.b.com": ("b.com", "com"), "x.a.co.uk": ("a.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"),
        "spam.net:8080": ("spam.net", "net"), "me@spam.net.": ("spam.net", "net"), "localhost": ("localhost", "localhost"), "": ("", ""), "[::1]:80": ("[::1]", "[::1]"), "com.fr": ("com.fr", "fr"),
    }
    df = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r.host: (r.d, r.s) for r in df.select("host", domain_of(F.col("host")).alias("d"), suffix_of(F.col("host")).alias("s")).collect()} == want


def brute(ids, x, k=10):
    out = {}
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), d[i]) for i in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall(spark, scale):
    d = f"/root/testdata/{scale}"
    rows = connect(d).sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    want, got = brute(ids, x), found(QUERIES["op7_hilbert_ann"](spark, d))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {(q, i): s for q, near in want.items() for i, s in near}
    assert all(abs(s - exact[q, i]) < 1e-12 for q, near in got.items() for i, s in near if (q, i) in exact)
    assert all(near == sorted(near, key=lambda p: (p[1], p[0])) for near in got.values())


@pytest.mark.parametrize("scale", ["sf0.1", "check_l"])
def test_production_windows_prune(spark, scale):
    """At the query's own share one ordering cannot find everything, at 2,000 rows and at 51,282; all of them find 0.9."""
    d = f"/root/testdata/{scale}"
    rows = connect(d).sql(f"SELECT vec_id, embedding FROM read_parquet('{d}/embeddings.parquet{'/*' if scale == 'check_l' else ''}') ORDER BY vec_id").fetchall()
    want = brute(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64))

    def recall(got):
        return sum(len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) for q in want) / sum(map(len, want.values()))

    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    assert recall(found(hilbert_ann.search(vectors, F.col("vec_id") % 100 == 0, orderings=1))) < 0.7
    assert recall(found(QUERIES["op7_hilbert_ann"](spark, d))) >= 0.9


def test_small_windows_find_most(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 6))[rng.integers(0, 20, 3000)] + 0.05 * rng.normal(size=(3000, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute(np.arange(3000), x)
    got = found(hilbert_ann.search(df, F.col("vec_id") % 100 == 0, rows=20, share=0.02, block=64))
    assert sum(len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) for q in want) >= 0.9 * 300


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (100, [0.0, 1.0]), (200, []), (2, [1.0, 0.1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = found(hilbert_ann.search(df, F.col("vec_id") % 100 == 0))
    assert [i for i, _ in got[0]] == [1, 2, 2, 100] and [i for i, _ in got[100]] == [2, 2, 0, 1] and set(got) == {0, 100}
    assert hilbert_ann.search(df.limit(0), F.lit(True)).count() == 0


def test_rows_that_repeat_an_id_are_candidates(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [1.0, 0.2]), (1, [1.0, 0.2]), (7, [3.0, 3.0])], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, round(r.score, 6)) for r in hilbert_ann.search(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(1, 1, 0.2), (2, 1, 0.2), (3, 1, 0.5), (4, 7, 3.605551)]
    # queries dealt over several groups find the same
    x = np.random.default_rng(2).normal(size=(900, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    one, many = (found(hilbert_ann.search(df, F.lit(True), block=b)) for b in (2000, 16))
    assert one == many


def test_hilbert_order_is_a_walk():
    side = 1 << 3
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    key = hilbert_ann.hilbert_keys(cells, 3)
    walk = cells[np.argsort(key)]
    assert sorted(key) == list(range(side**3)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
