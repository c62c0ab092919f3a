import pytest

from tidemark.llm.html_extract import extract, parse, subtrees, text_of

CASES = [
    ("<p>one<p>two", "one\n\ntwo"),
    ("<article><h1>T &amp; t</h1><p>a\n  b<br>c <i>d</i>e</p></article>", "T & t\n\na b c de"),
    ("<nav>n</nav><header>h</header><main><p>x</p><aside>s</aside><form>f<button>b</button></form></main><footer>f</footer>", "x"),
    ("<body class='has-sidebar'><div class='ad'>a</div><article><p>x</p><div id='comments'><p>c</p></div></article><div>outside</div></body>", "x"),
    ("<article><p>x</p></article><section class='comments'><article><p>reader</p></article></section>", "x"),
    ("<div class='cookie-notice'>ok?</div><div class='story'><p>y</p></div>", "y"),
    ("<script>var t='</p>';</script><style>p{}</style><p>z</p><!-- c <p>no</p> --><noscript>n</noscript>", "z"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"),
    ("<p title='a > b' data-x=\"</p>\">q</p>", "q"),
    ("a < b &lt; c &copy &#233;&#x41; &nbsp;&bogus;", "a < b < c © éA &bogus;"),
    ("<article><p>unclosed <b>bold", "unclosed bold"),
    ("<article><header><h1>Title</h1></header><p>t</p></article>", "Title\n\nt"),
    ("<p hidden>h</p><p style='display: none'>h</p><p>v</p>", "v"),
    ("<p>a</p></div></p><p>b</p><a href='x>broken", "a\n\nb\n\nbroken"),
    ("<![CDATA[x]]><p>y</p><?php z ?>", "x\n\ny"),
    ("", ""),
    ("   ", ""),
    ("plain", "plain"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_text(page, text):
    assert text_of(parse(page))[0] == text


def test_deep_and_long_pages():
    assert text_of(parse("<div>" * 20_000 + "x"), "h", {1: True})[0] == "x"
    assert len(text_of(parse("<article>" + "<p>word</p>" * 50_000 + "</article>"))[0]) == 50_000 * 6 - 2
    assert text_of(parse("<p " + "a='" * 20_000)) is not None


def test_article_is_no_template():
    page = parse("<div><article><p>x</p></article></div>")
    assert text_of(page, "", {slot: True for slot, _, _ in subtrees(page).values()})[0] == "x"


def test_subtrees_even_out_what_differs_from_page_to_page():
    of = lambda page: {(slot, own) for slot, own, _ in subtrees(parse(page), "a.com").values()}
    assert of("<div class='m b' id='n12'><a href='/1'>Page 3 of  a.com</a></div>") == of("<div class='b m' id='n7'><a href='/2'>Page 99 of a.com</a></div>")
    assert of("<div>x</div>") != of("<div>y</div>")
    assert {x[0] for x in of("<div>x</div>")} == {x[0] for x in of("<div>y</div>")}
    ((_, _, one), (_, _, other)) = (next(iter(subtrees(parse(f"<div><nav>n</nav><p>{x}</p></div>")).values())) for x in "xy")
    assert one != other


PAGES = "page_id long, url string, html string, host string, hash string, n string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES)


def test_templates_are_counted_by_host(spark):
    """What recurs on a host goes there, and stays on another; articles stay even as copies."""
    box = "<div class='x1'><p>Our shop is open</p></div>"
    rows = [(k, f"https://a.example.com/{k}", f"<body>{box}<div><p>story {chr(97 + k)}</p></div></body>") for k in range(20)]
    rows += [(100 + k, f"http://b.example.com/{k}", f"<body>{box if k == 0 else ''}<div><p>tale {chr(97 + k)}</p></div></body>") for k in range(20)]
    rows += [(200 + k, "http://c.example.com", "<body><article><p>same</p></article></body>") for k in range(20)]
    rows += [(300, None, "<p>no url</p>"), (301, "x", None), (302, "http://d", ""), (302, "http://d", ""), (None, "http://e", "<p>e</p>")]
    got = extract(pages_of(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[k] == f"story {chr(97 + k)}" for k in range(20))
    assert text[100] == "Our shop is open\n\ntale a"
    assert all(text[200 + k] == "same" for k in range(20))
    assert (text[300], text[301], text[302], text[None]) == ("no url", "", "", "e")
    assert all(r.n_chars == len(r.text) for r in got)


def brute(pages):
    """(host, slot) and whether it is the site's, by counting in plain Python."""
    import re

    met, n_pages = {}, {}
    for url, page in pages:
        host = (re.search(r"(?s)\A.*?://([^/?#]*)", url) or [0, ""])[1].lower()
        n_pages[host] = n_pages.get(host, 0) + 1
        for slot, own, around in subtrees(parse(page), host).values():
            met.setdefault((host, slot), {}).setdefault(own, set()).add(around)
    out, alike = {}, {}
    for (host, slot), contents in met.items():
        some = sum(len(x) > 1 for x in contents.values()), len(contents), sum(map(len, contents.values()))
        if n_pages[host] >= 30:
            alike[slot] = tuple(map(sum, zip(alike.get(slot, (0, 0, 0)), some, strict=True)))
        out[host, slot] = some
    verdict = {}
    for (host, slot), (again, n, total) in out.items():
        a, b, c = alike.get(slot, (0, 1, 0))
        if total >= 100:
            x = True if again / n >= 0.3 else False if again / n <= 0.06 and total >= 200 else None
        else:
            x = True if c >= 100 and a / b >= 0.3 else None
        if x is not None:
            verdict[host, slot] = x
    return verdict


def test_verdicts_match_brute_force(spark):
    from pyspark.sql import functions as F

    from tidemark.llm import html_extract as he

    pages = [(r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    seen, hosts = {}, {}
    for url, page in pages:
        host = url.split("://")[1].split("/")[0].split("?")[0].split("#")[0].lower()
        hosts[host] = hosts.get(host, 0) + 1
        for key in set(subtrees(parse(page), host).values()):
            seen.setdefault((host, *key[:2]), set()).add(key[2])
    counts = spark.createDataFrame([(*k, len(v)) for k, v in seen.items()], "host string, slot long, hash long, n long")
    found = he.templates(counts, spark.createDataFrame(list(hosts.items()), "host string, n_pages long"), template=0.3, own=0.06, sure=100, pooled=30, least=10, most=0.5)
    got = {(r.host, r.key): r.value for r in found.select("host", F.explode("slots")).collect()}
    assert got == brute(pages)
    assert sum(got.values()) > 100


@pytest.fixture(scope="module")
def extracted(spark):
    return {r.page_id: r for r in extract(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).collect()}


def unmarked(page):
    """The page without any tag or class that says what is article, menu, footer or advert."""
    for old, new in (("<article>", "<div class='c'>"), ("</article>", "</div>"), ("<nav>", "<div class='n'>"), ("</nav>", "</div>"), ("<footer>", "<div class='f'>"), ("</footer>", "</div>"), ("class=\"ad\"", "class='x'")):
        page = page.replace(old, new)
    return page


def test_counts_alone_find_the_article(spark, extracted):
    """No tag helps here: each host's recurring slots go, and with counting off the boilerplate stays."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    want = {k: r.text for k, r in extracted.items()}
    bare = pages_of(spark, [(k, u, unmarked(x)) for k, u, x in rows])
    got = {r.page_id: r for r in extract(bare).collect()}
    assert sum(got[k].text == want[k] for k in want) >= 0.97 * len(want)
    assert sum(r.n_template for r in got.values()) > 2.9 * len(want)
    off = {r.page_id: r.text for r in extract(bare, sure=1 << 40, least=1 << 40).collect()}
    assert not any(off[k] == want[k] for k in want)


def test_most_elements_go_by_counts_where_there_are_enough_pages(extracted):
    got = list(extracted.values())
    template, marked = sum(r.n_template for r in got), sum(r.n_marked for r in got)
    assert template > 0.6 * (template + marked - len(got))  # a page's head goes by its tag always


def test_what_is_the_pages_own_stays_whatever_its_tag(spark):
    """On a host of many pages a nav that never recurs is no menu of the site; on a host of few it goes by its tag."""
    rows = [(k, "http://a/x", f"<nav>contents of {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]}</nav><div class='top'>site</div><p>t</p>") for k in range(240)]
    rows += [(1000, "http://b/x", "<nav>menu</nav><p>t</p>")]
    got = {r.page_id: r.text for r in extract(pages_of(spark, rows)).collect()}
    assert got[17] == "contents of hlu\n\nt"
    assert got[1000] == "t"


def test_large_template_tables_are_joined_by_shuffle(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert sorted(extract(pages, max_sent=0).collect()) == sorted(extract(pages).collect())


def test_empty_table(spark):
    assert extract(pages_of(spark, [])).collect() == []


def test_articles_of_the_tables(spark):
    """Brute force on pages that are all of one simple shape: the blocks of the article and nothing else."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
