"""Templates of hosts and the text they leave, against brute force and literal pages."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings as hyp
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterline.llm import template
from meterline.llm.common import freeze
from meterline.llm.markup import ARTICLE, DEEPEST, MAIN, OTHER, read_page

WORDS = "river stone lamp green quick idle moon forest paper seven glass iron".split()


def prose(seed, n=12):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n)) + f" {seed}."


def texts(html):
    page = read_page(html)
    best = page.article()
    return [b.text for b in page.blocks if b.region == best]


@pytest.mark.parametrize("html,expected", [
    (None, []), ("", []), ("plain &amp; simple", ["plain & simple"]), ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]),
    ("<p><b>bold <i>x</b> y<br><p>z", ["bold x y", "z"]),
    ("<script>var t='</p><p>no</p>'</script><p>yes", ["yes"]), ("<style>p{}</style><title>no</title>a", ["a"]), ("<script>never closed <p>no", []),
    ("a<!-- <p>no --> b<!---->c<!-->d", ["a bcd"]), ("a<!-- open to the end", ["a"]), ("a<p title='1 > 2'>b", ["a", "b"]), ('a<p title="open', ["a"]),
    ("1 < 2 and 3<4 <5", ["1 < 2 and 3<4 <5"]), ("<ul><li>one<li>two<ul><li>in</ul>back</ul>", ["one", "two", "in", "back"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a b", "c", "d"]), ("&#233;t&eacute;&nbsp;&nbsp;x&lt;b&gt;\n\t y", ["été x<b> y"]),
    ("<nav>no</nav><header>no</header><p>yes</p><footer>no</footer><form>no<p>no</form>", ["yes"]),
    ("<main><p>yes</p><aside>no</aside></main><div>no</div>", ["yes"]), ("<div>no</div><article><header><h1>T</h1></header>yes<footer>no</footer></article>", ["T", "yes"]),
    ("<article>yes<article>a comment</article></article>", ["yes"]), ("<article>yes<section id='comments'><p>no</section></article>", ["yes"]),
    ("<div class='cookie-notice'>no</div><div role=navigation>no</div><p hidden>no<p style='display: none'>no<p>yes", ["yes"]),
    ("<body class='has-sidebar no-ads'><article class='ad-free'>yes", ["yes"]), ("<p>yes <span class=ad>no</span>too", ["yes too"]),
    ("</p></div>a</article>", ["a"]), ("<P>A</P><ARTICLE>b</ARTICLE>", ["b"]),
])
def test_blocks_of_a_page(html, expected):
    assert texts(html) == expected


def test_reading_is_linear_and_whole():
    deep = "<div><b>" * 60_000 + "deep" + "</b>" * 10
    assert texts(deep) == ["deep"] and DEEPEST == 512
    assert texts("<a \"" * 50_000) == []
    long = read_page("<article>" + "".join(f"<p>{prose(k)}" for k in range(20_000)))
    assert len(long.blocks) == 20_000 and long.article() == ARTICLE
    assert read_page("<main>x").article() == MAIN and read_page("x").article() == OTHER


@hyp(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<li>", "<ul>", "</ul>", "<b>", "</b>", "<td>", "<tr>",
                                 "<table>", "a", " b&lt;", "<script>", "</script>", "<!--", "-->", "<br>", "<"]), max_size=30))
def test_any_markup_is_read(parts):
    page = read_page("".join(parts))
    assert all(b.text == " ".join(b.text.split()) != "" for b in page.blocks)
    assert [t for t in page.tokens if t & 1] == [b.token for b in page.blocks]
    assert all(page.tokens[b.at] == b.token for b in page.blocks)


def page_of(k, host):
    menu = "".join(f"<li><a href='/{i}'>{prose(k * 7 + i, 1)}</a>" for i in range(3 + k % 4))
    if host == "article":
        body = f"<article><h1>{prose(k, 4)}</h1>" + "".join(f"<p>{prose(k * 100 + i)}</p>" for i in range(1 + k % 5)) + "<p>Sign up for our letter!</p></article>"
    elif host == "plain":
        body = f"<div class='body'><p>{prose(k, 20)}</p><p>{prose(k + 1000, 20)}</p></div>"
    else:  # copies of one article
        body = f"<article><p>{prose(1)}</p><p>{prose(2)}</p></article>"
    links = "<div class='links'>" + " ".join(f"<a href=x>{prose(k * 31 + i, 2)}</a>" for i in range(3)) + "</div>"
    comments = f"<div class='comments'><p>{prose(k + 9)}</div>" if k % 2 else ""
    return f"<html><body><nav><ul>{menu}</ul></nav><div>All rights reserved</div>{body}{comments}{links}<footer>{host} {prose(k, 2)}</footer></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://{'user@' if k == 3 else ''}{host.upper()}.example:80/{k}", page_of(k, host), "x") for host in ("article", "plain", "copies") for k in range(24)]
    rows += [(None, "http://article.example/", None, "x"), (900, None, "<p>no host", "x"), (901, "not a url", "", "x"), (902, "https://single.example", page_of(5, "plain"), "x")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")


def expected_of(k, host):
    if host == "article":
        return "\n\n".join([prose(k, 4), *(prose(k * 100 + i) for i in range(1 + k % 5))])
    if host == "plain":
        return f"{prose(k, 20)}\n\n{prose(k + 1000, 20)}"
    return f"{prose(1)}\n\n{prose(2)}"


def test_main_text(spark, pages):
    got = template.extract(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        name = r.host.split(".")[0]
        if name in ("article", "plain", "copies") and r.page_id is not None:
            # The line that all articles of the host end with is template; copies of one article lose nothing.
            assert r.text == expected_of(r.page_id, name), (r.host, r.page_id)
    by_id = {r.page_id: r.text for r in got if r.page_id is None or r.page_id >= 900}
    assert by_id[None] == "" and by_id[900] == "no host" and by_id[901] == ""
    # One page shows no template: only names tell what stands beside its text.
    assert expected_of(5, "plain") in by_id[902]


def test_classes_as_brute_force(spark, pages):
    rows = freeze(template.read(template.with_host(pages).withColumn("row", F.monotonically_increasing_id())), "test")
    vectors, sizes = defaultdict(lambda: defaultdict(dict)), Counter()
    for r in rows.collect():
        sizes[r.host] += 1
        for t, n in Counter(r.tokens).items():
            vectors[r.host][t][r.row] = n
    expected = set()
    for host, found in vectors.items():
        groups = defaultdict(list)
        for t, vector in found.items():
            if len(vector) >= 4 and len(vector) * 5 >= sizes[host]:
                groups[frozenset(vector.items())].append(t)
        expected |= {(host, min(g), len(v), tuple(sorted(g))) for v, g in groups.items() if len(g) >= 2}
    got = template.occurrence_classes(rows.repartition(5)).collect()
    assert {(r.host, r["class"], r.pages, tuple(r.tokens)) for r in got} == expected and len(got) == len(expected)


def test_templates_are_ordered_and_nested(spark, pages):
    rows = freeze(template.read(template.with_host(pages).withColumn("row", F.monotonically_increasing_id())), "test")
    found = template.templates(rows).where("host = 'article.example'").collect()
    valid = {r["class"]: r for r in found}
    assert any(r.parent == 0 for r in found) and any(r.parent in valid for r in found)
    for r in rows.where("host = 'article.example'").collect():
        for c in found:
            mine = [t for t in r.tokens if t in set(c.tokens)]
            assert mine == list(c.tokens) * (len(mine) // len(c.tokens))


def test_order_crossing_and_slots_decide_validity():
    orders, parents, crossing = template._walk([2, 4, 6, 4, 6, 8], {2: 2, 8: 2, 4: 4, 6: 4}, {2: 2, 4: 2})
    assert orders == {2: [2, 8], 4: [4, 6]} and parents == {2: {(0, -1)}, 4: {(2, 0)}} and not crossing
    orders, _, _ = template._walk([4, 4, 6, 6], {4: 4, 6: 4}, {4: 2})
    assert orders == {4: None}
    _, _, crossing = template._walk([2, 4, 8, 6], {2: 2, 8: 2, 10: 2, 4: 4, 6: 4}, {2: 2, 4: 2})
    assert crossing == {2}


def test_one_order_on_every_page_is_needed(spark):
    html = lambda k: f"<nav>{k}</nav><section>{prose(k)}</section>" if k % 2 else f"<section>{prose(k)}</section><nav>{k}</nav>"
    pages = spark.createDataFrame([(k, "http://h.example/", html(k)) for k in range(12)], "page_id bigint, url string, html string")
    rows = freeze(template.read(template.with_host(pages).withColumn("row", F.col("page_id"))), "test")
    assert template.occurrence_classes(rows).count() == 1 and template.templates(rows).count() == 0
    assert {r.page_id: r.text for r in template.extract(pages).collect()} == {k: prose(k) for k in range(12)}


def test_query_counts_code_points(spark, tmp_path):
    rows = [(1, "http://a.example/", "<p>été \U0001f600"), (1, "http://a.example/", "<p>été \U0001f600"), (2, None, None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in template.op13_template_text(spark, str(tmp_path)).collect())
    assert got == {(1, "http://a.example/", "été \U0001f600", 5): 2, (2, None, "", 0): 1}
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert template.op13_template_text(spark, f"{tmp_path}/none").count() == 0
