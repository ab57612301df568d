"""Scalar expressions against plain Python statements of their rules."""

import hashlib
import random
import re
from urllib.parse import parse_qsl, urlencode, urlsplit

import pytest
from pyspark.sql import functions as F

from newsloom.config import FOOTBALL_TERMS, TRACKING_PARAMS, TREND_TERMS, TRANSFER_TERMS
from newsloom.functions import dates, html, text, topics, urls


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def rule_normalize_url(url):
    if not url:
        return ""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", url):
        url = f"https://{url}"
    parts = urlsplit(url)
    host = parts.netloc.lower()
    for scheme, port in (("http", ":80"), ("https", ":443")):
        if parts.scheme == scheme and host.endswith(port):
            host = host[: -len(port)]
    path = parts.path or "/"
    head, _, tail = path.rpartition("/")
    if tail.endswith(";") and tail.count(";") == 1:
        path = f"{head}/{tail[:-1]}"
    kept = sorted(p for p in parse_qsl(parts.query, keep_blank_values=True) if p[0] not in TRACKING_PARAMS)
    query = urlencode(kept)
    return f"{parts.scheme}://{host}{path}" + (f"?{query}" if query else "")


URLS = [
    None, "", "example.com", "HTTP://Example.COM:80/A?b=2&a=1#x", "https://h.com:443", "https://h.com:80/",
    "https://h.com/?utm_source=x&ref=y", "https://h.com/p?utm_Source=x", "https://h.com/p?q=a+b&z=%C3%A9&z=*~",
    "https://h.com/p?a=&b&=c", "https://h.com/p;", "https://h.com/p;x=1?y=%zz", "ftp://h.com/x y", "h.com/a?x=1;y=2",
    "https://h.com/p?a=1&&b=2&", "https://u:P@H.com/", "https://h.com?x=1", "https://h.com/a?b=c=d",
]


def test_normalize_url(spark):
    rng = random.Random(1)
    keys = ["a", "b", "ref", "utm_source", "q", "é"]
    made = [
        rng.choice(["http://", "HTTPS://", "", "https://"]) + rng.choice(["Ex.com", "a.B.org:80", "x.io:443"])
        + rng.choice(["", "/", "/a/B", "/a;", "/ü"]) + "?"
        + "&".join(f"{rng.choice(keys)}={rng.choice(['1', 'x y', '%41', '%', '', 'a%2Fb', '*'])}" for _ in range(rng.randrange(4)))
        + rng.choice(["", "#frag", "#a?b"])
        for _ in range(300)
    ]
    values = URLS + made
    assert apply(spark, values, urls.normalize_url) == [rule_normalize_url(v) for v in values]


def test_domains(spark):
    values = ["https://WWW.H.com:8080/x", "https://u@h.com?x", "nothing", None]
    assert apply(spark, values, urls.url_domain) == ["www.h.com:8080", "u@h.com", "", ""]
    pairs = spark.createDataFrame(
        [(" WWW.Abc.org ", "https://x.com/"), ("", "https://www.x.com/"), (None, "https://Y.com")], "d string, u string"
    )
    got = [r[0] for r in pairs.select(urls.publisher_domain(F.col("d"), F.col("u"))).collect()]
    assert got == ["abc.org", "x.com", "y.com"]


def test_whitespace_and_hash(spark):
    every = "".join(chr(c) for c in range(1, 0x3100) if re.match(r"\s", chr(c)))
    values = [None, "", "  a  b ", f"x{every}y{every}", every, "a b\r\n\tc", "one"]
    want = [re.sub(r"\s+", " ", v or "").strip() for v in values]
    assert apply(spark, values, text.normalize_text) == want
    assert apply(spark, values, text.content_id) == [hashlib.sha1(w.encode()).hexdigest() for w in want]
    assert apply(spark, [f"{every}x{every}"], text.strip) == ["x"]


def test_snippet_counts_code_points(spark):
    values = ["é" * 500, "é" * 501, None]
    assert apply(spark, values, text.snippet) == ["é" * 500, "é" * 500 + "...", None]


def test_safe_int(spark):
    values = ["12", " 7 ", "-3", "3.7", "x", "", None, "99999999999"]
    assert apply(spark, values, text.safe_int) == [12, 7, -3, None, None, None, None, None]


def test_embedding_text(spark):
    rows = spark.createDataFrame([("t ", " c"), (" ", "c"), ("t", None), (None, None)], "t string, c string")
    got = [r[0] for r in rows.select(text.embedding_text(F.col("t"), F.col("c"))).collect()]
    assert got == ["t. c", "c", "t", ""]


def test_choose_content(spark):
    rows = spark.createDataFrame(
        [(True, "text", "ex"), (None, "text", "ex"), (False, "", "ex"), (False, None, None), (True, "text", None)],
        "p boolean, t string, e string",
    )
    got = [r[0] for r in rows.select(text.choose_content(F.col("p"), F.col("t"), F.col("e"))).collect()]
    assert got == ["ex", "text", "ex", "", ""]


def test_string_list(spark):
    values = ['{"v":null}', "{}", '{"v":["a",null,1]}', '{"v":"one"}', '{"v":3}', '{"v":[]}']
    fn = lambda c: text.string_list(F.variant_get(F.parse_json(c), "$.v", "variant"))
    assert apply(spark, values, fn) == [[], [], ["a", "1"], ["one"], ["3"], []]


SIGNALS = [
    ("Striker arrives on loan", "contract until June", "transfers"),
    ("Standings after round nine", "a winning streak", "trends"),
    ("a trunk of information", None, "trends"),
    ("forbidden", "", "transfers"),
    ("release", "clause", "transfers"),
    (None, None, "general_news"),
    ("quiet", "day", "general_news"),
]


def test_classify_signal(spark):
    rows = spark.createDataFrame([s[:2] for s in SIGNALS], "t string, e string")
    none = F.array().cast("array<string>")
    fresh = topics.classify_signal(F.col("t"), F.col("e"), none)
    kept = topics.classify_signal(F.col("t"), F.col("e"), none, F.lit("given"))
    got = rows.select(fresh.alias("a"), kept.alias("b")).collect()
    assert [r["a"] for r in got] == [s[2] for s in SIGNALS]
    assert {r["b"] for r in got} == {"given"}


def test_word_lists_reduce_without_change():
    for terms in (TRANSFER_TERMS, TREND_TERMS, FOOTBALL_TERMS):
        small = topics._minimal(terms)
        assert all(any(s in t for s in small) for t in terms)


@pytest.mark.parametrize(
    "row, want",
    [
        ({"league": "premier_league"}, True),
        ({"bucket": "la_liga"}, True),
        ({"league": "finance", "bucket": "la_liga"}, False),
        ({"title": "Sevilla draw at home"}, True),
        ({"keywords": ["Interview"]}, True),
        ({"title": "rates", "bucket": "finance"}, False),
    ],
)
def test_is_topic_article(spark, row, want):
    fields = ("league", "bucket", "title", "excerpt", "content", "publisher_name")
    df = spark.createDataFrame(
        [tuple(row.get(f) for f in fields) + (row.get("keywords"),)],
        ", ".join(f"{f} string" for f in fields) + ", keywords array<string>",
    )
    assert df.select(topics.is_topic_article(*[F.col(f) for f in (*fields, "keywords")])).first()[0] is want


def test_league_label(spark):
    assert apply(spark, ["serie_a", "finance", None, "premier_league"], topics.league_label) == [
        "Serie A", None, None, "Premier League",
    ]


def test_feed_dates(spark):
    values = [
        "Mon, 10 Mar 2025 08:00:00 GMT", "Mon, 10 Mar 2025 08:00:00 +0200", "10 Mar 2025 08:00:00 EST",
        "Mon, 3 Mar 2025 08:00 GMT", "2025-03-10T08:00:00Z", "2025-03-10T08:00:00+02:00", "2025-03-10", "soon", "", None,
    ]
    got = apply(spark, values, lambda c: dates.parse_feed_date(c).cast("string"))
    assert got == [
        "2025-03-10 08:00:00", "2025-03-10 06:00:00", "2025-03-10 13:00:00", "2025-03-03 08:00:00",
        "2025-03-10 08:00:00", "2025-03-10 06:00:00", "2025-03-10 00:00:00", None, None, None,
    ]
    status = apply(spark, values, lambda c: dates.date_status(c, dates.parse_feed_date(c)))
    assert status == ["ok"] * 7 + ["bad", "missing", "missing"]


def test_query_dates(spark):
    values = ["2024-01-05", " 2024-01-05T10:00:00Z ", "2024-01-05T10:00:00+02:00", "2024-01-05 10:00", "", "  ", "x", "2024", None]
    got = apply(spark, values, lambda c: dates.parse_query_date(c).cast("string"))
    assert got == ["2024-01-05 00:00:00", "2024-01-05 10:00:00", "2024-01-05 08:00:00", "2024-01-05 10:00:00"] + [None] * 5


def test_page_text(spark):
    page = (
        "<html><head><title>A &amp; B</title></head><body><NAV>menu</NAV><!-- c --><p>One&nbsp;&lt;two&gt;</p>"
        "<script>x<y</script ><aside class='a'>no</aside><p>three\nfour</p><footer>f</footer></body></html>"
    )
    assert apply(spark, [page, "", None], html.page_text) == ["One <two> three four", "", ""]


PROSE = "The council met on Monday evening and after three hours of debate agreed to repair the old bridge before winter comes."


def test_main_text_leaves_menus_and_footers(spark):
    """Menu, advert and footer outside the elements that are always dropped go; the article with its title stays."""
    menu = "<div class='menu'>" + "".join(f"<a href='/{i}'>Section {i}</a> " for i in range(9)) + "</div>"
    page = (
        f"<html><head><title>T</title></head><body><div>Advert: buy now</div>{menu}<div><h1>Bridge to be repaired</h1>"
        f"<p>{PROSE}</p><p>{PROSE} See <a href='x'>the minutes</a>.</p><p>It will cost two million.</p></div>"
        "<ul><li><a>Next</a></li><li><a>Previous</a></li></ul><div>Copyright</div><div>2024</div></body></html>"
    )
    want = f"Bridge to be repaired {PROSE} {PROSE} See the minutes . It will cost two million."
    assert apply(spark, [page], html.main_text) == [want]


def test_main_text_prefers_the_marked_part(spark):
    aside = "".join(f"<div>{PROSE} {i}</div>" for i in range(3))
    long = f"<body>{aside}<MAIN id=a><p>{PROSE}<p>{PROSE} again</main>{aside}</body>"
    stub = f"<body><article>Short</article>{aside}</body>"
    unclosed = f"<body><article><p>{PROSE}"
    assert apply(spark, [long, unclosed], html.main_text) == [f"{PROSE} {PROSE} again", PROSE]
    assert apply(spark, [stub], html.main_text)[0].count(PROSE) == 3


def test_main_text_of_odd_pages(spark):
    pages = [None, "", "plain words only", "<p>\x01\x02\x03\x04\x05</p>", "<a>" + "word " * 50 + "</a>", "<p>" + "long " * 60_000]
    assert apply(spark, pages, html.main_text) == ["", "", "", "", "", ("long " * 60_000).strip()]


def rule_is_main(blocks, i):
    before = blocks[i - 1] if i else (0, 0)
    after = blocks[i + 1] if i + 1 < len(blocks) else (0, 0)
    words, links = blocks[i]
    if links / words > 1 / 3:
        return False
    if before[0] and before[1] / before[0] > 5 / 9:
        return words > 40 or after[0] - after[1] > 17
    return words > 16 or after[0] - after[1] > 15 or before[0] - before[1] > 4


def test_blocks_are_judged_by_the_tree(spark):
    rng = random.Random(4)
    pages, want = [], []
    for _ in range(40):
        blocks = [(n := rng.choice([1, 4, 5, 15, 16, 17, 18, 40, 41]), rng.choice([0, 0, n // 3, n // 2, n])) for _ in range(rng.randint(1, 8))]
        texts = ["<div>" + (f"<a>{'in ' * k}</a>" if k else "") + "out " * (n - k) + "</div>" for n, k in blocks]
        pages.append("".join(texts))
        want.append([(*b, rule_is_main(blocks, i)) for i, b in enumerate(blocks)])
    got = apply(spark, pages, lambda c: F.transform(html.main_blocks(c), lambda b: F.struct(b["words"], b["links"], b["main"])))
    assert [[tuple(b) for b in row] for row in got] == want
