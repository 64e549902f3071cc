"""HTML extraction, WARC archives and URL judgement."""

import base64
import hashlib
import html
import io
import re
from collections import defaultdict

import pytest
import zstandard

from tidefolio.llm import html_text, url_filter, warc
from tidefolio.session import new_table_path

SF = "/root/testdata/sf0.01"


def article(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inside))).split())


def test_every_page_gives_its_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = html_text.extract(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        assert r["text"] == article(r["html"]) and r["n_chars"] == len(r["text"])


SOUP = """<html><head><title>No</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="top"><a href=/>Home</a> <a href=/x>News</a></div>
<div class="cookie-notice">We use cookies. Accept?</div><div class="wrap"><div class="x1"><h2>Title here</h2>
<p>First   paragraph, with <b>bold</b>text; and more &amp; more&hellip; all right.<p>Ok.</p><ul><li>Item one, is good.<li>Item two</ul>
<div class="ad">Buy now, or never!</div><form><p>Your name, please.</p><input></form><p>Second<br>paragraph: a &lt; b, and on, until it ends.</p><script>if (a<b) "</p>"</script></div>
<div class="side"><ul><li><a>Link</a></li><li><a>Other link</a></li></ul></div></div><!-- <p>no, no, no.</p> -->
<div id="comments"><p>Great post, thanks, really!</p></div><footer>Copyright, 2020.</footer></body></html>"""


def test_page_without_an_article_element():
    want = (
        "Title here First paragraph, with boldtext; and more & more… all right. Ok. Item one, is good. Item two "
        "Second paragraph: a < b, and on, until it ends."
    )
    assert html_text.main_text(SOUP) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p></p><!-- x", ""),
        ("plain text, no tags", "plain text, no tags"),
        ("<p>a<p>b <script>x<y</script>c", "a b c"),
        ("<main><p>One, two.</p><nav>x</nav><p>&#233;&nbsp;&eacute;</p></main>", "One, two. é é"),
        ("<p>1 < 2, and <3.</p>", "1 < 2, and <3."),
        ('<p title="a>b">in, here.</p>', "in, here."),
        ("<nav>only</nav><script>var x</script>", ""),
        ("<article><p>Text, one.</p><style>p{}</style><div hidden>gone</div></article><article><p>x</p></article>", "Text, one. x"),
    ],
)
def test_small_pages(page, want):
    assert html_text.main_text(page) == want


TWELVE = [f"Sentence number {i}, with some words, ends here." for i in range(12)]
FOUR = [f"<p>{t}</p>" for t in TWELVE]


@pytest.mark.parametrize(
    "page",
    [
        "<body><nav>Home, news.</nav><div class='content has-sidebar'>{}</div><div class='sidebar'><p>More, here.</p></div></body>",
        "<body><form action='/'><input name='q'>{}</form><footer>Imprint, 2020.</footer></body>",
        "<body><article><h1>Title</h1><h2 id='related-work'>Related work</h2>{}</article></body>",
        "<body><article>{}<p id='share-prices'>Shares, too.</p></article></body>",
        "<body><article><section id='legal-history'><h2>Law</h2>{}</section></article></body>",
        "<body><div id='sidebar' class='x'>{}</div></body>",
    ],
)
def test_marks_do_not_take_out_the_article(page):
    got = html_text.main_text(page.format("".join(FOUR)))
    assert all(t in got for t in TWELVE)
    assert not re.search("Home|More, here|Imprint", got)
    for kept in ("Related work", "Shares, too.", "Law"):
        assert (kept in page) == (kept in got)


@pytest.mark.parametrize("tag", ["section", "article"])
@pytest.mark.parametrize("share", [6, 8, 10])
def test_containers_beside_each_other_are_kept(tag, share):
    parts = ["".join(FOUR[:share]), "".join(FOUR[share:])]
    page = f"<body><nav>Home</nav><{tag}><h2>One</h2>{parts[0]}</{tag}><{tag}><h2>Two</h2>{parts[1]}</{tag}><div class='comments'><p>Nice, thanks!</p></div></body>"
    want = " ".join(["One", *TWELVE[:share], "Two", *TWELVE[share:]])
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("mark", ["related-posts", "share-buttons", "newsletter-signup", "post-comments", "ad", "cookie-notice"])
def test_plain_marks_inside_an_article_count(mark):
    page = f"<article>{''.join(FOUR)}<div class='{mark}'><p>Other things, not this.</p></div></article>"
    assert html_text.main_text(page) == " ".join(TWELVE)


def test_odd_markup_is_read_in_linear_time():
    assert len(html_text.main_text("<p>word, word. " * 20_000).split()) == 40_000
    html_text.main_text('<a "' * 20_000)
    html_text.main_text("<" * 100_000)
    assert html_text.main_text("<div>" * 100_000 + "deep, text." + "</i></table>" * 50_000) == "deep, text."
    assert len(html_text.main_text("<div>a, <b>" * 30_000)) == 30_000 * 3 - 1


def test_extraction_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, None, "x", 1), (1, None, "x", 1), (None, "<p>a, b.</p>", None, 2)], "page_id long, html string, TEXT string, n int")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "html", "n", "text", "n_chars"]
    assert sorted((r["text"], r["n_chars"]) for r in got.collect()) == [("", 0), ("", 0), ("a, b.", 5)]
    assert html_text.extract(pages.where("n > 5")).collect() == []


PAGES = [
    (1, "http://a/", "same"),
    (2, "http://b/é \r\nX: y", "same"),
    (2, "http://b/", "same"),
    (3, None, None),
    (4, "u", ""),
    (5, "u", "long " * 100_000),
    (None, "u", "same"),
    (None, "u", "alone é"),
    (1, "http://a/again", "same"),
]


def expected(pages, least=0):
    by = defaultdict(list)
    for i, _, h in pages:
        by[h or ""].append(i)
    out = []
    for i, url, h in pages:
        body = (h or "").encode()
        ids = [x for x in by[h or ""] if x is not None]
        to = min(ids) if ids and len(body) >= least and i != min(ids) else None
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, url, len(body), digest, "response" if to is None else "revisit", to, body if to is None else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, least):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string")
    got = warc.archive_and_read(pages, least).collect()
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    rows = sorted((tuple(bytes(r[n]) if n == "payload" and r[n] is not None else r[n] for n in names) for r in got), key=repr)
    assert rows == expected(PAGES, least)


def test_empty_archive(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_records_are_frames_of_their_own_after_a_dictionary(spark):
    path = new_table_path(spark, "warc")
    warc.write_archives(spark.read.parquet(f"{SF}/pages.parquet").coalesce(1), path)
    files = [r["content"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    assert len(files) == 1
    data = bytes(files[0])
    assert data[:4] == warc.DICTIONARY_FRAME
    size = int.from_bytes(data[4:8], "little")
    raw = zstandard.decompress(data[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True)
    assert reader.read().count(b"WARC/1.1\r\n") == 250  # a plain reader passes over the separators
    assert sum(1 for _ in warc.read_archive(data)) == 250
    plain = sum(len(zstandard.compress(r)) for r in warc.read_archive(data))
    assert len(data) < plain  # the dictionary pays


def test_archives_without_a_dictionary_and_broken_ones():
    assert list(warc.read_archive(b"".join(warc.archive(iter([b""]))))) == [b""]
    frames = list(warc.archive(iter([b"abc", b"abcd"])))
    assert list(warc.read_archive(warc.FILLER.join(frames))) == [b"abc", b"abcd"]
    with pytest.raises(ValueError, match="no Zstandard frame"):
        list(warc.read_archive(b"garbage"))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_archive(frames[0] + frames[1][:-2]))


def test_archive_holds_back_only_the_sample(monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE", 50)
    taken = []

    def source():
        for i in range(100):
            taken.append(i)
            yield b"0123456789"

    frames = warc.archive(source())
    next(frames)
    assert len(taken) == 5


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def test_rules_and_parts(spark):
    cases = {
        1: ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("https://b.net/en/", "b.net", "/en/", "net/", "block"),
        3: ("https://c.net", "c.net", "", None, "allow"),
        4: ("https://notnet/x", "notnet", "/x", None, "allow"),
        5: ("http://example.com/de/?x", "example.com", "/de/", "example.com/de/", "block"),
        6: ("http://myexample.com/de/", "myexample.com", "/de/", None, "allow"),
        7: ("http://x.org/fr/#://z", "x.org", "/fr/", "org/fr/", "allow"),
        8: ("no url", "", "", None, "allow"),
        9: (None, "", "", None, "allow"),
        10: ("", "", "", None, "allow"),
        11: ("a://b?c/d", "b", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, c[0], None, "x") for i, c in cases.items()] + [(1, cases[1][0], None, "x")], "page_id long, url string, html string, rule string")
    got = url_filter.judge_urls(pages, RULES)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted([(i, *c[1:]) for i, c in cases.items()] + [(1, *cases[1][1:])])
    assert url_filter.judge_urls(pages.where("page_id > 99"), RULES).collect() == []
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().optimizedPlan().toString())


def slow_spread(edges, seeds, damping=url_filter.DAMPING):
    """Received trust and distrust by host, from the equations they solve."""
    out, hosts = defaultdict(float), {h for e in edges for h in e} | set(seeds)
    for (a, _), n in edges.items():
        out[a] += n
    trust, distrust = dict.fromkeys(hosts, 0.0), dict.fromkeys(hosts, 0.0)
    for _ in range(400):
        t, d = dict.fromkeys(hosts, 0.0), dict.fromkeys(hosts, 0.0)
        for (a, b), n in edges.items():
            part = damping * n / out[a]
            own_t, own_d = seeds.get(a, (0, 0))[0], seeds.get(b, (0, 0))[1]
            t[b] += part * (own_t + trust[a])
            d[a] += part * (own_d + (1 - own_d) * distrust[b])
        trust, distrust = t, d
    return trust, distrust


def link(*hosts):
    return " ".join(f'<a href="https://{h}/p">x</a>' for h in hosts)


def judged(spark, pages):
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r["host"]: r["verdict"] for r in url_filter.judge_urls(frame, RULES).collect()}


def test_link_graph(spark):
    """A host that links to blocked hosts alone is blocked, one that trusted hosts link to is not."""
    pages = [
        ("http://bad.net/", link("worse.net")),
        ("http://farm.info/", link("bad.net", "BAD.net") + "<a href='//bad.net/z'>y</a>" + '<a href="/local">l</a>'),
        ("http://good.org/fr/", link("shop.info", "good.org")),
        ("http://shop.info/", link("bad.net")),
        ("http://plain.info/", None),
    ]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    edges = {("bad.net", "worse.net"): 1, ("farm.info", "bad.net"): 3, ("good.org", "shop.info"): 1, ("shop.info", "bad.net"): 1}
    assert {(r["src"], r["dst"]): r["links"] for r in url_filter.host_edges(frame).collect()} == edges
    want = {"farm.info": "block", "shop.info": "allow", "plain.info": "allow", "bad.net": "block", "good.org": "allow"}
    assert judged(spark, pages) == want


def test_verdicts_do_not_depend_on_size(spark):
    """One, two, five or a hundred linkers of a blocked host, crawled or not, get the same verdict."""
    for crawled in (True, False):
        pages = [("http://a1.net/", None)] if crawled else []
        for n, target in ((1, "a1.net"), (2, "a2.net"), (5, "a5.net"), (100, "a100.net")):
            pages += [(f"http://l{i}.to{n}.info/", link(target)) for i in range(n)]
        got = judged(spark, pages)
        assert {v for h, v in got.items() if h.endswith(".info")} == {"block"}


def test_a_host_is_not_blocked_for_its_own_paths(spark):
    pages = [("http://example.com/de/", None), ("http://example.com/de/2", None), ("http://example.com/fr/", None), ("http://x.info/", link("example.com"))]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(frame, RULES).collect()}
    assert got[0] == got[1] == "block" and got[2] == "allow"
    assert got[3] == "block"  # two thirds of what it links to is blocked, damped


def test_spread_by_its_equations_on_a_random_graph(spark):
    import random

    draw = random.Random(3)
    hosts = [f"h{i}" for i in range(30)]
    edges = {(a, b): draw.randint(1, 5) for a in hosts for b in draw.sample(hosts, 4) if a != b}
    seeds = {h: (draw.random(), draw.choice([0.3, 1.0])) for h in draw.sample(hosts, 8)}
    got = url_filter.spread(
        spark.createDataFrame([(*e, n) for e, n in edges.items()], "src string, dst string, links long"),
        spark.createDataFrame([(h, *m) for h, m in seeds.items()], "host string, trust double, distrust double"),
    ).collect()
    trust, distrust = slow_spread(edges, seeds)
    assert len(got) == len({h for e in edges for h in e})
    for r in got:
        assert r["trust"] == pytest.approx(trust[r["host"]], abs=0.05) and r["distrust"] == pytest.approx(distrust[r["host"]], abs=0.002)
        assert r["distrust"] <= 1
