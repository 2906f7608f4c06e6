import html
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import dom as D
from bazaarlens.llm import extraction as X

KIND = "page_id long, url string, html string"


def extract(spark, rows, kind=KIND, **more):
    found = X.main_text(spark.createDataFrame(rows, kind), **more)
    return found, {r.page_id: r.text for r in found.collect()}


def prose(draw, n=12):
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 8))) for _ in range(n))


# --- reading -----------------------------------------------------------------------------------


def kept(page):
    return [b.text for b in D.parse(page)[1] if not D.dropped(b.node)]


@pytest.mark.parametrize(
    "page,texts",
    [
        ("", []),
        ("only text", ["only text"]),
        ("<p>a<p>b <b>c</b>d<br>e", ["a", "b cd e"]),
        ("<p title='a>b'>x<!-- <p>c</p> -->y</p>", ["xy"]),
        ("<p>&lt;b&gt; &amp &#65;&nbsp;\n\t z&am</p>", ["<b> & A z&am"]),
        ("<script>if(a<b)'</p>'</script><style>p{}</style><p>x", ["x"]),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", ["a", "b", "1", "2", "3"]),
        ("<nav>m</nav><header>h<h1>t</h1></header><aside>s</aside><form>f</form><footer>g</footer><p>x", ["x"]),
        ("<div class=cookie-notice>c</div><div id=mainNav>n</div><div role=banner>b</div><p hidden>h</p><p>x", ["x"]),
        ("<body class='no-sidebar'><div class=content-sidebar-wrap><p>x</p></div>", ["x"]),
        ("<article class='post has-comments'><header>by<h1>t</h1></header><p>x</p></article>", ["t", "x"]),
        ("<article class=comment><p>no</article><section id=comments><p>no</section>x", ["x"]),
        ("<head><title>t</title><p>x", ["x"]),
        ("<p>a</i></div></p>b<b><p>c</b>d", ["a", "b", "cd"]),
        ("<a href='unclosed", []),
    ],
)
def test_reading(page, texts):
    assert kept(page) == texts


def test_long_and_deep_pages_take_linear_time():
    for page in ("<p>x" * 50_000, "<div>" * 5_000 + "x", "<div>x" * 5_000, "<h2>a</h2><p>b</p><div>c</div>" * 3_000):
        layout, blocks = X._page(page)
        assert len(" ".join(b.text for b in blocks)) >= page.count("x")
        assert D.written_out(D.read_in(layout)) == layout


# --- matching ----------------------------------------------------------------------------------


def random_tree(draw, depth=3):
    kids = tuple(random_tree(draw, depth - 1) for _ in range(draw.randint(0, 3))) if depth else ()
    return draw.choice("ab"), kids, []


def brute_weight(a, b):
    if a[0] != b[0]:
        return 0
    best = 0
    for k in range(1, min(len(a[1]), len(b[1])) + 1):
        for i in combinations(a[1], k):
            for j in combinations(b[1], k):
                best = max(best, sum(brute_weight(x, y) for x, y in zip(i, j)))
    return 1 + best


def test_weight_against_all_matchings():
    draw = random.Random(5)
    for _ in range(60):
        a, b = random_tree(draw), random_tree(draw)
        assert D.weight(a, b) == brute_weight(a, b)


def test_merging_keeps_the_nodes_of_both():
    a, b = D.read_in("x(a,b(c),d)"), D.read_in("x(b(e,c),f,d)")
    assert D.written_out(D.merged(a, b)) == "x(a,b(e,c),f,d)"
    assert D.aligned(D.read_in("x(b(c),q(r))"), D.read_in("x(a,b(e,c),d)")) == ["0", "2", "4", "0/q", "0/q/r"]


def test_long_lists_match_in_order():
    a = tuple((draw, (), []) for draw in "ab" * 200)
    b = tuple((draw, (), []) for draw in "ba" * 200)
    pairs = list(D.matching(a, b))
    assert [i for i, _ in pairs if i is not None] == list(range(400)) == [j for _, j in pairs if j is not None]


# --- whole pages -------------------------------------------------------------------------------


def site(draw, host, n, varied=True):
    """Pages without any telling tag or name but for links, and their articles."""
    rows, wanted = [], {}
    for i in range(n):
        texts = [prose(draw) for _ in range(draw.randint(1, 6))]
        links = "".join(f"<li><a href=x>{prose(draw, 2)}</a></li>" for _ in range(draw.randint(2, 5)))
        body = "".join(f"<p>{html.escape(t)}</p>" for t in texts)
        extra = "<div>We use biscuits.</div>" if varied and i % 2 else ""
        page = f"<html><body><div>{host}: all the news</div><div><ul>{links}</ul></div>{extra}<div>{body}</div><div>Write to us</div></body></html>"
        key = len(rows) + 1000 * (hash(host) % 7919)
        rows.append((key, f"https://{host}/{i}", page))
        wanted[key] = " ".join(texts)
    return rows, wanted


def test_constant_nodes_and_menus_go_without_any_name(spark):
    draw = random.Random(2)
    rows, wanted = [], {}
    for host, n in (("a.example", 40), ("b.example", 8)):
        more, w = site(draw, host, n)
        rows += more
        wanted |= w
    assert extract(spark, rows)[1] == wanted


def test_copies_are_no_template(spark):
    """An article that most pages of a host have stays."""
    draw = random.Random(3)
    one = "".join(f"<p>{prose(draw)}</p>" for _ in range(4))
    rows = [(i, "http://copies.example/", f"<nav>{prose(draw, 3)}</nav><article>{one}</article>") for i in range(30)]
    rows += [(i, "http://copies.example/", f"<article><p>{prose(draw)}</p></article>") for i in range(30, 40)]
    _, got = extract(spark, rows)
    assert all(got[i] == " ".join(kept(r[2])) for i, r in enumerate(rows))


def test_a_constant_line_inside_articles_goes(spark):
    draw = random.Random(4)
    texts = [prose(draw, 30) for _ in range(20)]
    rows = [(i, "http://a.example/", f"<article><p>{t}</p><p>Tell your friends</p></article>") for i, t in enumerate(texts)]
    assert extract(spark, rows)[1] == dict(enumerate(texts))


def test_articles_before_main_before_the_rest(spark):
    rows = [
        (1, "http://x/", "<p>teaser</p><main><p>m</p><article><p>a</p></article></main>"),
        (2, "http://y/", "<p>teaser</p><main><p>m</p><div><a href=z>link list</a></div></main>"),
        (3, "http://z/", "<p>teaser</p><div id=content><p>c</p></div>"),
        (4, "http://w/", "<p>one</p><div>two</div>"),
    ]
    assert extract(spark, rows)[1] == {1: "a", 2: "m", 3: "c", 4: "one two"}


def test_nulls_empty_long_and_repeated_rows(spark):
    long = "<article>" + "<p>many words</p>" * 20_000 + "</article>"
    rows = [(1, None, None), (2, None, ""), (None, "no host", "<p>x</p>"), (3, "http://h/", long), (3, "http://h/", long), (4, "http://h/", " ")]
    found, got = extract(spark, rows)
    assert found.count() == 6
    assert got == {1: "", 2: "", None: "x", 3: " ".join(["many words"] * 20_000), 4: ""}
    assert extract(spark, [])[1] == {}


def test_clashing_names_are_carried_along(spark):
    kind = KIND + ", host string, shape int, `a.b` int, blocks int, TEXT string, fixed int"
    found, got = extract(spark, [(1, "http://h/", "<p>x</p>", "hh", 1, 2, 3, "old", 4)], kind)
    assert found.columns == ["page_id", "url", "host", "shape", "a.b", "blocks", "fixed", "text"]
    assert tuple(found.first()) == (1, "http://h/", "hh", 1, 2, 3, 4, "x")


def test_layouts_beyond_the_template_are_counted_too(spark):
    """With one layout as the template, a constant node of another one is still found."""
    draw = random.Random(7)
    rows, wanted = site(draw, "c.example", 30)
    assert extract(spark, rows, layouts=1)[1] == wanted


def test_given_pages(spark):
    """The given pages, whose articles are marked, against their own marks."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in X.main_text(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.where(F.col("page_id") % 5 == 0).collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        for tag in ("<p>", "</p>", "<h1>", "</h1>", "<br>"):
            article = article.replace(tag, " ")
        assert got[r.page_id] == " ".join(html.unescape(article.replace("<b>", "").replace("</b>", "")).split())
