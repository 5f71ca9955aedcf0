import random

from pyspark.sql import functions as F

from orrery.llm import html_extract as H


def page(body, notice="Our site uses cookies"):
    return f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{x}}</style><script>var a="</p><article>no</article>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="box1">{notice}</div>
{body}<aside>Side</aside><section id="comments"><p>First!</p></section><form>Name <input> <button>Go</button></form><footer>&copy; 2020</footer></body></html>"""


def test_article():
    got = H.extract(page('<article><h1>A  &lt;b&gt;</h1><p>One <b>two</b>th<i>ree</i>\n four.<p>Five<br>six &amp; &eacute;<div class="ad">Buy</div><ul><li>x<li>y</ul><!-- gone --></article>'))
    assert got == "A <b> One twothree four. Five six & é x y"


def test_main_and_body():
    assert H.extract(page("<main><p>Body text</p><div class='share-links'>Tweet</div></main>")) == "Body text"
    assert H.extract("<p>Alone</p><ul><li><a href=x>menu one</a></li></ul><div hidden>no</div>tail") == "Alone tail"


def test_layout_words_and_comments():
    inner = "<article><p>Kept</p></article><div class='comments'><article class='comment'><p>Me too</p></article></div>"
    assert H.extract(f"<body class='has-sidebar'><div class='page sidebar-right'>{inner}</div><div class='sidebar'>Links</div></body>") == "Kept"
    assert H.extract("<div><article class='comment'>no</article><article class='post'>yes</article></div>") == "yes"
    assert H.extract("<div class='cookie-notice'>no</div><div class='story'>yes</div>") == "yes"


def test_malformed():
    assert H.extract("<article><p><b>bold<p>next</article><footer>f") == "bold next"
    assert H.extract("a < b <3 &amp; c > d <br/> e <unclosed") .startswith("a < b <3 & c > d")
    assert H.extract('<p title="a>b">x</p><script>while(1<2){}') == "x"
    assert H.extract(None) == "" and H.extract("") == ""
    assert H.extract("<div>" * 3000 + "deep") == "deep"


def test_tree_matching_against_all_alignments():
    rng = random.Random(1)

    def tree(depth):
        tags = ["div", "section", "ul", "table"]
        return "".join(f"<{t} class=k{rng.choice('ab')}>{tree(depth - 1) if depth else ''}</{t}>" for t in rng.choices(tags, k=rng.randint(0, 4)))

    def best(a, b):
        def lists(x, y):
            if not x or not y:
                return 0
            here = best(x[0], y[0]) + lists(x[1:], y[1:]) if x[0].label == y[0].label else 0
            return max(here, lists(x[1:], y), lists(x, y[1:]))

        return 1 + lists(a.children, b.children)

    for _ in range(60):
        a, b = H.folded(tree(2)), H.folded(tree(2))
        pairs = []
        found = H.align(a, b, pairs)
        assert found == len(pairs) == best(a, b)
        assert all(x.label == y.label for x, y in pairs)


def test_induced_template(spark):
    rows = []
    for i in range(30):
        body = f"<div><h2>Title {i}</h2><p>Text number {i} of this page.</p><p>The same line.</p></div><div class='x'>Read our magazine, now with pictures</div>"
        rows.append((i, "http://One.example/a", page(body, "Welcome to this fine site of ours")))
    rows += [(100, "http://two.example/", page("<article>Solo</article>")), (101, None, None), (None, "bad url", "<p>x</p>"), (102, "http://one.example:80/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit("h"))
    got = {r["page_id"]: r for r in H.main_text(df).collect()}
    assert len(got) == len(rows)
    for i in range(30):
        assert got[i]["text"] == f"Title {i} Text number {i} of this page. The same line."
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[100]["text"] == "Solo" and got[101]["text"] == "" and got[None]["text"] == "x" and got[102]["text"] == ""
    assert H.main_text(df.limit(0)).count() == 0


def test_copies_are_no_template(spark):
    body = "<div><p>The whole article, which was copied often.</p></div>"
    rows = [(i, "http://c.example/", page(body)) for i in range(20)]
    got = {r["text"] for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 1 and "The whole article, which was copied often." in got.pop()


def plain(i, told):
    return f"<html><body><div><h2>Title {i}</h2><p>Text number {i} of this page.</p></div><div class='x'>{told}</div></body></html>"


def test_first_page_is_a_stub(spark):
    told = "Read our magazine, now with pictures"
    rows = [(0, "http://s.example/", "<html><body><p>Moved</p></body></html>")] + [(i, "http://s.example/", plain(i, told)) for i in range(1, 21)]
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Moved"
    assert all(got[i] == f"Title {i} Text number {i} of this page." for i in range(1, 21))


def test_two_layouts(spark):
    def other(i):
        return f"<html><body><div class='shop'><p>Goods of number {i}</p></div><section class='y'>Parcels leave every day</section></body></html>"

    told = "Read our magazine, now with pictures"
    rows = [(i, "http://t.example/", plain(i, told) if i % 3 else other(i)) for i in range(60)]
    # Too few of a third for a vote: they go by the most common one.
    rows += [(100 + i, "http://t.example/", plain(100 + i, told).replace("<body>", f"<body><section class='{'abc'[i]}'>Note {i}</section>")) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(60):
        assert got[i] == (f"Title {i} Text number {i} of this page." if i % 3 else f"Goods of number {i}")
    assert all(got[100 + i] == f"Note {i} Title {100 + i} Text number {100 + i} of this page." for i in range(3))


def test_layout():
    a = "<html><body><div class='page'><div class='a1'><p>x</p></div><div class='b'><ul><li>y</ul></div></div></body></html>"
    assert H.layout(a) == H.layout(a.replace("<p>x</p>", "<h2>z</h2><p>x<p>y").replace("a1", "a27"))
    assert H.layout(a) != H.layout(a.replace("'b'", "'c'")) and H.layout(None) == H.layout("")


def test_an_articles_own_parts_stay():
    inner = (
        "<p>One <span class='alert'>two</span> <a class='share' href='/'>three</a></p><section id='discussion'><p>Four</p></section>"
        "<div class='popular-science'>five</div><div class='related-work'>six</div><div class='ad'>no</div><ul class='share social'><li>no</ul><div class='cookie-notice'>no</div>"
    )
    assert H.extract(page(f"<article>{inner}</article>")) == "One two three Four five six"
    assert H.extract(page(f"<main>{inner}</main>")) == "One two three Four five six"


def test_any_depth():
    for n in (10, 190, 200, 210, 450, 5_000):
        deep, shut = "<div>" * n, "</div>" * n
        assert H.extract(f"{deep}<p>a</p><form>no <div>no</div> <b>no</b></form><p>b<br>c</p>d{shut}<p>e</p>") == "a b c d e"
        assert H.extract(f"<body>{deep}<div>x</div>y<article><div class='ad'>no</div><p>In <i>the</i> article</p><div>end</div></article>z{shut}</body>") == "In the article end"
        assert H.extract(f"<article>{'<b>' * n}te{'</b>' * n}xt</article>") == "text"
        tree = H.folded(deep + "x" + shut)
        assert H.align(tree, H.folded(deep + "y" + shut), []) > min(n, 190)


def test_template_decides_without_an_article(spark):
    told = "<div class='one'>Read our magazine, now with pictures</div><div class='two'><span>All our papers</span></div>"
    rows = [(i, "http://w.example/", f"<html><body><div><p>Story {i} is told here.</p></div>{told}</body></html>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} is told here." for i in range(12)}
    assert all(H.extract(html) != got[i] for i, _, html in rows)


def test_very_long_page(spark):
    body = "".join(f"<p>Sentence {i}.</p><h2>Head {i}</h2><div>more</div>" for i in range(1_500))
    rows = [(i, "http://l.example/", f"<html><body><nav>no</nav><article>{body}<p>{i}</p></article></body></html>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: str(i) for i in range(6)}  # 4,500 blocks that no page changes are template


def test_subject_words_outside_articles():
    for part in ("<div class='popular-science'>The sun</div>", "<section id='discussion'>The sun</section>", "<div class='alert-system-story'>The sun</div>", "<p><a href=x>The sun</a></p>"):
        assert H.extract(page(part, "")) == "The sun"
    assert H.extract("<p>Intro</p><div class='popular-science'>The sun</div><div class='popular-posts'>no</div>") == "Intro The sun"
    assert H.extract("<p>Intro</p><section id='discussion'>no</section><p><a href=x>no</a></p>") == "Intro"
    for part in ("<div class='comments'>no</div>", "<div class='site-menu'>no</div>", "<article></article><div id='related'>no</div>", "<ul><li><a href=x>no</a></ul>"):
        assert H.extract(page(part, "")) == ""


def test_an_articles_formulas_and_fallbacks_stay():
    inner = "<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p><object data=x>A table</object><noscript><p>A figure</p></noscript><div class='menu'>Soup of the day</div><div class='menu'><a href=x>no</a></div>"
    assert H.extract(page(f"<article>{inner}</article>")) == "So x=1. A table A figure Soup of the day"
    assert H.extract("<noscript>no</noscript><p>yes</p>") == "yes"


def test_main_parts_at_any_depth():
    kinds = [("main", "article", "Deep"), ("header", "article", "Deep"), ("article", "header", "Deep"), ("aside", "main", "after")]
    kinds += [("div class='ad'", "article", "after"), ("h1", "header", "after"), ("h1", "div", "Deep after")]
    for n in (3, 99, 100, 101, 5_000):
        for a, b, want in kinds:
            tree = f"<{a}><{b}>" * n + "<h2>Deep</h2>" + f"</{b.split()[0]}></{a.split()[0]}>" * n
            assert H.extract(tree + "<p>after</p>") == want
            assert H.align(H.folded(tree), H.folded(tree), []) > 0
