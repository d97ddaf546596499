import duckdb
import pytest

from tideframe.llm import urls

LINK = '<LINK data-x="1" href="{}" rel="Canonical">'
MOVE = "<meta http-equiv=refresh content=\"0; URL='{}'\">"
PAGES = [
    (1, "https://a.example.net/es/1", "<p>"), (2, "http://b.example.org/en/1?x=1#top", LINK.format("https://A.example.net/es/1")),
    (3, "https://c.example.org/en/2", MOVE.format("http://b.example.org/en/1?x=1")), (4, "https://d.example.org/en/2", None),
    (5, "https://www.example.com/en/9", ""), (6, "https://m.example.com/en/9", ""), (7, "http://example.com/en", ""), (8, "HTTP://X.COM", ""),
    (9, "http://x.com:80/a", ""), (10, None, "<p>"), (11, "no scheme", LINK.format("https://a.example.net/es/1")), (12, "", ""), (13, "x://É.Net/es/?q://", ""),
    (14, "https://e.example.org/5", LINK.format("https://f.example.org/5")), (15, "http://f.example.org/5#x", LINK.format("http://g.com/") + LINK.format("http://h.net/fr/")),
    (4, "https://d.example.org/en/2", None), (None, "http://net/fr/", ""), (16, "http://xnet/fr/", ""), (17, "http://y.com?/a/", "<link rel='canonical' href='/relative'>"),
    (18, "https://i.example.org/?" + "q" * 50_000, "x" * 100_000), (19, "http://a://net/es/", ""),
]


def run(out, sql, pages):
    con = duckdb.connect()
    table = pages.toArrow()
    con.register("pages", table)
    want = sorted(con.execute(sql).fetchall(), key=str)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == want
    return {r[0]: r for r in got}


def test_aliases_against_sql(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = run(urls.op9_urls(spark, str(tmp_path)), urls.ORACLE, pages)
    verdict = {k: v[-1] for k, v in got.items()}
    assert [verdict[i] for i in (1, 2, 3, 4)] == ["block", "block", "block", "allow"]
    assert verdict[14] == verdict[15] == "allow"  # an allow rule beside a block rule
    assert got[5][3] == "www.example.com/en/" and got[6][3] == "example.com/en/" and got[8][2:4] == ("", None)
    assert got[13][1] == "É.net" and verdict[None] == "block" and got[16][3] is None


@pytest.mark.parametrize("longest", ["net/es/x", "es/"])
def test_longest_rule(spark, longest):
    rules = (("block", "net/es/"), ("allow", longest))
    pages = spark.createDataFrame([(1, "http://a.net/es/xy", None, 5)], "page_id long, url string, html string, host int")
    r = urls.judge(pages, rules).first()
    assert (r.verdict, r.rule) == (("allow", longest) if longest == "net/es/x" else ("block", "net/es/"))
    assert urls.allowed(pages, rules).columns == pages.columns


def test_empty_and_chain(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(pages, urls.RULES).count() == 0
    chain = [(i, f"http://n{i}.org/", LINK.format(f"http://n{i + 1}.org/")) for i in range(40)] + [(40, "http://n40.org/", LINK.format("http://z.net/fr/"))]
    df = spark.createDataFrame(chain, "page_id long, url string, html string")
    assert {r.verdict for r in urls.judge(df, urls.RULES).collect()} == {"block"}
    assert urls.allowed(df, urls.RULES).count() == 0


@pytest.mark.parametrize(
    ("target", "url", "want"),
    [
        ("/en/x", "http://a.org/b/c?d#e", "x://a.org/en/x"), ("//h.net/x", "http://a.org", "x://h.net/x"), ("x?y=1#z", "http://a.org/b/c", "x://a.org/b/x?y=1#z"),
        ("x", "http://a.org", "x://a.org/x"), ("../x", "http://a.org/b/c/d", "x://a.org/b/x"), ("../../../x", "http://a.org/b/c", "x://a.org/x"), ("./", "http://a.org/b/c", "x://a.org/b/"),
        ("..", "http://a.org/b/c/d", "x://a.org/b/"), ("?q", "http://a.org/b/c?d", "x://a.org/b/c?q"), ("#q", "http://a.org/b/c?d#e", "x://a.org/b/c?d"),
        ("/go?to=http://z.net/", "http://a.org/b", "x://a.org/go?to=http://z.net/"), ("HTTPS://z.net/../x", "http://a.org/b", "HTTPS://z.net/../x"), ("mailto:a@z.net", "http://a.org/b", None),
        ("/x", "no scheme", None), ("/x", None, None), (None, "http://a.org", None), ("", "http://a.org", None),
    ],
)
def test_targets_seen_from_a_page(target, url, want):
    assert urls.resolve(target, url) == want


def test_character_references():
    assert urls.plain_attribute("?a=1&amp;b=2&copy=3&#38;c&#x3d;4&nosuch;&amp") == "?a=1&b=2&copy=3&c=4&nosuch;&"


def test_relative_and_escaped_aliases(spark):
    pages = [
        (1, "https://a.net/es/1?a=1&b=2", ""), (2, "http://b.org/p", LINK.format("http://a.net/es/1?a=1&amp;b=2")),
        (3, "http://b.org/q/r", LINK.format("/s")), (4, "https://b.org/s", MOVE.format("//c.net/fr/1")),
        (5, "http://b.org/q/t", MOVE.format("../s?")), (6, "http://b.org/q/u", "<base href='http://c.net/fr/'>" + LINK.format("v")),
        (7, "http://b.org/s?", LINK.format("r1") + LINK.format("https://b.org/q/r")), (8, "http://b.org/w", LINK.format("mailto:x@c.net")),
        (9, "http://example.com:80/en/1", ""), (10, "https://net:443/es/1", None), (11, "http://ported.org:80/x", ""), (12, "https://ported.org/x", ""), (13, "http://ported.org/y", LINK.format("x")),
    ]
    rules = (*urls.RULES, ("block", "ported.org:80/"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.id: r.verdict for r in urls.judge(df, rules).collect()}
    assert {i for i, v in got.items() if v == "block"} == {*range(1, 14)} - {8}
    alone = df.where("page_id IN (8, 9, 10)")  # no links between pages
    assert [r.verdict for r in urls.judge(alone, urls.RULES).orderBy("id").collect()] == ["allow", "block", "block"]
