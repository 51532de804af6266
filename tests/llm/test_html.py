import random
import time
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from terrafold.llm import html
from terrafold.llm.html import Node, blocks, extract_text, parse, tree_match

SCHEMA = "page_id long, url string, html string, host string, text string, model string"


def pages(spark, rows):
    return spark.createDataFrame([(p, u, h, "x", "y", "z") for p, u, h in rows], SCHEMA)


def shape(x):
    return [c if isinstance(c, str) else (c.tag, shape(c)) for c in x.children]


def test_parse_mends_markup():
    assert shape(parse("<p>a<p>b<ul><li>c<li>d</ul></x>e")) == [("p", ["a"]), ("p", ["b"]), ("ul", [("li", ["c"]), ("li", ["d"])]), "e"]
    assert shape(parse("<script>if (a<b) '</p>'</script >t<br/>u<!-- <p>no -->1 < 2")) == [("script", []), "t", ("br", []), "u", "1 ", "<", " 2"]
    assert [b.text for b in blocks(parse("<p> a&amp;b\n <b>c</b>d<br>e</p>&nbsp;<div>&lt;f&#33;</div>"))] == ["a&b cd e", "<f!"]


def brute_size(a, b):
    """Simple tree matching by plain recursion over sequences of children."""
    if a.tag != b.tag:
        return 0

    def best(p, q):
        return 0 if not p or not q else max(best(p[1:], q), best(p, q[1:]), brute_size(p[0], q[0]) + best(p[1:], q[1:]))

    return 1 + best([c for c in a.children if isinstance(c, Node)], [c for c in b.children if isinstance(c, Node)])


def test_tree_match_is_a_largest_matching():
    trees = [parse(f"<div>{x}</div>").children[0] for x in ("<p>1<p>2<ul><li>a<li>b</ul><h2>x</h2>", "<h2>x</h2><p>2<ul><li>a</ul>", "<ul><li>a<li>b<li><b>c</b></ul><p>9", "", "<span><b>q</b></span><p>r<i>s</i></p>")]
    for a in trees:
        for b in trees:
            pairs = tree_match(a, b)
            assert len(pairs) == brute_size(a, b) and all(x.tag == y.tag for x, y in pairs)


def test_constant_nodes_are_template_and_slots_are_content(spark):
    rows = [(k, f"http://h.example/{k}", f"<body><div>Site name</div><div><h1>Title {k}</h1><p>Text &amp; more {k}</p></div><div>All rights reserved</div></body>") for k in range(6)]
    rows += [(50, "http://one.example/", "<nav>menu</nav><p>Alone</p><aside>side</aside><div class='user-comments'><p>hey</p></div><form>f</form><div id=cookieNotice>c</div>")]
    rows += [(60 + k, "http://same.example/", "<p>Equal pages are one vote</p>") for k in range(5)]
    got = {r.page_id: (r.text, r.n_chars) for r in extract_text(pages(spark, rows)).collect()}
    for k in range(6):
        assert got[k] == (f"Title {k}\n\nText & more {k}", len(f"Title {k}\n\nText & more {k}"))
    assert got[50][0] == "Alone" and got[60][0] == "Equal pages are one vote"


def test_edges(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no url", "plain text"), (4, "http://h/", "<article>" + "<p>x y</p>" * 3000 + "</article><footer>f</footer>"), (4, "http://h/", "<div>" * 2000 + "deep"), (5, "http://h/", "<p>é &notanentity; &#x41;</p>"), (5, "http://h/", "<p>é &notanentity; &#x41;</p>")]
    got = [(r.page_id, r.text, r.n_chars) for r in extract_text(pages(spark, rows)).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert (1, "", 0) in got and (2, "", 0) in got and (3, "plain text", 10) in got
    assert ("x y\n\n" * 3000)[:-2] in {t for _, t, _ in got} and "deep" in {t for _, t, _ in got}
    assert extract_text(pages(spark, [])).count() == 0


def test_near_copies_of_one_article_keep_it(spark):
    text = " ".join(f"word{i}" for i in range(40))
    copy = lambda k: f"<nav><a href='/?s={k}'>in {k}</a></nav><article data-t='{k}'><h1>One title</h1><p>{text}</p></article><footer>{k}</footer>"
    rows = [(k, "http://copies/", copy(k)) for k in range(8)]
    rows += [(20 + k, "http://dates/", f"<div><p>{text}</p><p>Seen on day {k}</p></div>") for k in range(8)]
    rows += [(40 + k, "http://sites/", f"<div>The name of this site</div><p>{' '.join(f'w{k}x{i}' for i in range(5))}</p>") for k in range(8)]
    rows += [(60, "http://sites/", "<div>The name of this site</div>")]
    got = {r.page_id: r.text for r in extract_text(pages(spark, rows)).collect()}
    for k in range(8):
        assert got[k] == f"One title\n\n{text}" and got[20 + k] == f"{text}\n\nSeen on day {k}"
        assert got[40 + k] == " ".join(f"w{k}x{i}" for i in range(5))
    assert got[60] == ""


def test_deep_and_wide_pages(spark, monkeypatch):
    deep, wide = "<div>" * 2000 + "deep", "<p>x y</p>" * 20_000
    rows = [(1, "http://deep/", deep), (2, "http://wide/", wide)]
    rows += [(10 + k, "http://deeps/", "<div>" * (2000 + k) + f"deep {k}") for k in range(3)]
    got = {r.page_id: r.text for r in extract_text(pages(spark, rows)).collect()}
    assert got == {1: "deep", 2: ("x y\n\n" * 20_000)[:-2], 10: "deep 0", 11: "deep 1", 12: "deep 2"}
    a, b = parse(wide), parse("<h2>z</h2>" + wide + "<p><b>z</b></p>")
    assert len(tree_match(a, b)) == 20_001
    trees = [parse(f"<div>{x}</div>").children[0] for x in ("<p>1<p>2<h2><b>x</b></h2><p><i>3</i><p>4", "<p>0<h2>x</h2><p><i>3</i></p><p>4<h2>y</h2>")]
    pairs = tree_match(*trees)
    monkeypatch.setattr(html, "CELLS", 1)  # only some rows of each table are held
    assert tree_match(*trees) == pairs and len(pairs) == brute_size(*trees)


def test_names_of_elements(spark):
    page = "<div class='site-header'>Name</div><div class='layout has-sidebar'><div class='article-header'>x</div><article class='post'><header><h1>T</h1></header><p>one<p class='ad'>buy</p><p>two</p><section id='readerComments'><p>hey</p></section></article><article class='comment'>no</article></div>"
    bare = "<div class='header'>Name</div><div class='with-sidebar'><p>one</p><div class=notice>n</div><p>two</p></div>"
    got = {r.page_id: r.text for r in extract_text(pages(spark, [(1, "http://a/", page), (2, "http://b/", bare)])).collect()}
    assert got == {1: "T\n\none\n\ntwo", 2: "one\n\ntwo"}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n))


def named_pages(host, name, n=6, tag="div", seed=1):
    """Pages whose menu, advert and foot vary and call themselves nothing; the article's element has a name."""
    rng, rows, want = random.Random(seed), [], {}
    for k in range(n):
        title, a, b = words(rng, 3), words(rng, 40), words(rng, 25)
        links = "".join(f"<a href=/{k}>{words(rng, 2)}</a> " for _ in range(20))
        rows.append((k, f"http://{host}/{k}", f"<div>{links}</div><div>{words(rng, 6)}</div><{tag} class='{name}'><h1>{title}</h1><p>{a}</p><div class=ad>{words(rng, 4)}</div><p>{b}</p><p>Share this page</p></{tag}><div>{words(rng, 5)}</div>"))
        want[k] = f"{title}\n\n{a}\n\n{b}"
    return rows, want


@pytest.mark.parametrize(("name", "tag"), [("x1", "div"), ("promo-story", "article"), ("notice-of-award", "div"), ("search-results-article", "article"), ("promo-story", "div")])
def test_the_slot_is_found_whatever_it_is_called(spark, name, tag):
    rows, want = named_pages("names", name, tag=tag)
    assert {r.page_id: r.text for r in extract_text(pages(spark, rows)).collect()} == want
    alone = {r.page_id: r.text for r in extract_text(pages(spark, rows[:1])).collect()}  # too few pages for a slot or a template
    assert want[0].split("\n\n")[1] in alone[0]


def test_without_induction_the_result_is_another(spark, monkeypatch):
    rows, want = named_pages("names", "x1")
    monkeypatch.setattr(html, "VOTES", 100)
    got = {r.page_id: r.text for r in extract_text(pages(spark, rows)).collect()}
    assert all(got[k] != want[k] and want[k].split("\n\n")[1] in got[k] for k in want)


def test_without_names_of_elements_induction_gives_the_same_on_the_test_pages(spark, monkeypatch):
    host = F.regexp_extract("url", "//([^/]*)", 1)
    source = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("of", F.count("url").over(Window.partitionBy(host))).filter("of >= 5")
    with_names = {r.page_id: r.text for r in extract_text(source).collect()}
    rename = source.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<(/?)(nav|article|footer)>", "<$1div>"), "class=\"ad\"", ""))
    assert {r.page_id: r.text for r in extract_text(rename).collect()} == with_names


def brute_host(htmls):
    """Texts of one host's pages, the votes counted page by page."""
    model = min(htmls, key=len)
    numbers = html._exemplar(model)[1]
    seen, votes, size, totals = set(), {}, {}, {}
    for h in htmls:
        root = parse(h)
        found = blocks(root)
        of = {id(y): numbers[id(x)] for x, y in tree_match(html._exemplar(model)[0], root)}
        own = [b for b in found if b.words or not b.other]
        page = "\n".join(b.text for b in own)
        if page in seen:
            continue
        seen.add(page)
        size[page] = sum(len(b.text.split()) for b in own)
        for k, t in {(of[id(b.node)], b.text) for b in own if id(b.node) in of}:
            votes.setdefault(k, {}).setdefault(t, []).append(page)
        above = html._above(root)
        for b in found:
            x = b.node
            while x is not None and id(x) not in of:
                x = above.get(id(x))
            k = 0 if x is None else of[id(x)]
            totals[k] = totals.get(k, 0) + b.words
    if len(seen) < html.VOTES:
        return [html.main_text(html.Aligned(h, ""), {}, None) for h in htmls]
    template = {}
    for k, by in votes.items():
        t, n = max(((t, len(p)) for t, p in by.items()), key=lambda x: x[1])
        if n >= html.AGREE * len(seen):
            template[k] = t
    gone = {p: sum(len(t.split()) for k, t in template.items() if p in votes[k].get(t, ())) for p in seen}
    if sum(size[p] - gone[p] >= html.OWN * size[p] for p in seen if size[p]) < 0.5 * sum(size[p] > 0 for p in seen):
        template = {}
    slot = html.slot_of(model, tuple(sorted((k, n) for k, n in totals.items() if n)))
    return [html.main_text(html.Aligned(h, model), {k: html._digest(t) for k, t in template.items()}, slot) for h in htmls]


@pytest.mark.parametrize("seed", range(4))
def test_votes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for h in range(5):
        htmls = []
        for k in range(rng.randint(1, 9)):
            body = "".join(f"<{t}>{words(rng, rng.randint(1, 30))}</{t}>" for t in rng.choices(["p", "h2", "li", "b", "section"], k=rng.randint(0, 6)))
            same = f"<p>{'fixed words ' * h}</p>" if rng.random() < 0.95 else ""
            htmls.append(f"<div>name of {h}</div><div><div class=ad>{words(rng, 3)}</div>{same}{body}</div><div>{words(rng, 2)}</div>" + " " * 5000 * k)
        htmls += htmls[:1] if rng.random() < 0.5 else []
        for t, text in zip(htmls, brute_host(htmls)):
            want[len(rows)] = text
            rows.append((len(rows), f"http://h{h}/", t))
    assert {r.page_id: r.text for r in extract_text(pages(spark, rows)).collect()} == want


@pytest.mark.parametrize("text", ["<a " * 300_000, "<a \"" * 200_000, "<!" * 300_000, "<a<" * 200_000, "<b>" * 100_000 + "</p>" * 100_000, "<a '\"" * 100_000])
def test_parsing_takes_linear_time(text):
    began = time.thread_time()
    parse(text)
    assert time.thread_time() - began < 10


@pytest.mark.parametrize("text", ["<ul><li><ul>" + "<div>" * 50_000 + "<li>x</li>" * 70_000, "<table><tr><td><b>" * 40_000 + "<td>x" * 60_000, "<select><dl>" + "<b>" * 100_000 + "<option>x" * 60_000])
def test_items_below_deep_elements_take_linear_time(text):
    began = time.thread_time()
    parse(text)
    assert time.thread_time() - began < 4


PROBES = [
    '<div style="overflow:hidden"><p>{}</p></div>', '<p title="a hidden gem">{}</p>', '<p>{} <img alt="hidden &quot;display:none&quot;"></p>', '<p data-id="comment-5">{}</p>', '<p data-role="ad" grid=sidebar>{}</p>',
    '<section id="market-share"><p>{}</p></section>', '<div class="search-algorithms"><p>{}</p></div>', '<section id="legal"><p>{}</p></section>', '<p hiddenness=1 class="notice-of-award">{}</p>',
]
GONE = ['<div hidden><p>{}</p></div>', "<p style='color:red; DISPLAY : none'>{}</p>", '<div class="comment-list"><p>{}</p></div>', '<section id="comments"><p>{}</p></section>', "<div role=banner class='ad slot-2'>{}</div>"]


@pytest.mark.parametrize("n", [1, 5])
@pytest.mark.parametrize("shape", range(len(PROBES)))
def test_no_text_is_lost_by_attributes_that_do_not_hide_it(n, shape, spark_free_pages):
    assert spark_free_pages(PROBES[shape], n)[0]


@pytest.mark.parametrize("n", [1, 5])
@pytest.mark.parametrize("shape", range(len(GONE)))
def test_what_is_hidden_or_no_article_goes(n, shape, spark_free_pages):
    assert not spark_free_pages(GONE[shape], n)[0]


@pytest.fixture
def spark_free_pages():
    """Whether a probe's text is in a page's main text; of five pages their votes make the slot."""

    def run(probe, n):
        rng = random.Random(3)
        inner = [words(rng, 12) for _ in range(n)]
        made = [f"<div>{words(rng, 5)}</div><article><h1>{words(rng, 3)}</h1><p>{words(rng, 60)}</p>{probe.format(x)}<p>{words(rng, 50)}</p></article>" for x in inner]
        model = min(made, key=len)
        slot = None
        if n > 1:
            spread = sum((html.Aligned(m, model).words() for m in made), Counter())
            slot = html.slot_of(model, tuple(sorted(spread.items())))
        found = [html.main_text(html.Aligned(m, model if n > 1 else ""), {}, slot) for m in made]
        return [x in t for x, t in zip(inner, found)]

    return run


def test_a_named_part_of_a_voted_slot_is_content(spark_free_pages):
    assert all(spark_free_pages('<div class="notice"><p>{}</p></div>', 5))
    assert not spark_free_pages('<div class="notice"><p>{}</p></div>', 1)[0]


def test_deep_pages_of_one_host(spark):
    rows = [(k, "http://deep/", "<div>" * (1200 + k) + words(random.Random(k), 30)) for k in range(2)] + [(9, "http://deep/", "<a " * 20_000)]
    got = {r.page_id: r.text for r in extract_text(pages(spark, rows)).collect()}
    assert got[0] == words(random.Random(0), 30) and got[1] == words(random.Random(1), 30)


def test_pages_are_dealt_once(spark):
    """Each page is read for its host's exemplar, and once more for both passes over it."""
    rows, want = named_pages("http://a/", "page", 8)
    read = spark.sparkContext.accumulator(0)
    tick = F.udf(lambda x: read.add(1) or x, "string").asNondeterministic()
    got = extract_text(pages(spark, rows).withColumn("html", tick("html"))).collect()
    assert {r.page_id: r.text for r in got} == want and read.value == 2 * len(rows)
