"""Expressions on literal inputs."""

from pyspark.sql import functions as F

from newsgraph.functions import cards as CD, features as FT, scoring as S, text as T, trust as TR, urls as U
from newsgraph.sources import landing as L

c = F.col


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expr.alias("x")).first()["x"]


def test_event_types(spark):
    cases = [
        ("Startup raises seed round", "rss", "STARTUP_FUNDING"),
        ("Alpha acquires Beta", "rss", "M_AND_A"),
        ("Zero-day found in router", "rss", "SECURITY_INCIDENT"),
        ("CVE-2024-1234 patched", "rss", "SECURITY_INCIDENT"),
        ("Lab announces a small model", "rss", "MODEL_RELEASE"),
        ("Anything at all", "arxiv", "RESEARCH_PAPER"),
        ("Anything at all", "nvd", "SECURITY_INCIDENT"),
        ("A quiet day", "rss", "OTHER"),
    ]
    df = spark.createDataFrame(cases, "title string, kind string, want string")
    rows = df.select("title", FT.event_type(c("title"), c("kind")).alias("got"), "want").collect()
    assert [(r.title, r.got) for r in rows] == [(r.title, r.want) for r in rows]


def test_amounts(spark):
    cases = [("raises $12.5M now", 12_500_000), ("USD 900k and $1,250", 900_000), ("$2B deal", 2_000_000_000), ("none", None)]
    df = spark.createDataFrame(cases, "t string, want long")
    for row in df.select(T.funding_amount(c("t")).alias("got"), "want").collect():
        assert row.got == row.want


def test_url_key(spark):
    same = [
        "https://www.Example.com/story/?utm_source=x&b=2&a=1#frag", "http://example.com/story?a=1&b=2", "https://example.com/story/?b=2&a=1&ref=z&c=",
    ]
    df = spark.createDataFrame([(u,) for u in same], "u string")
    assert {r.k for r in df.select(U.url_key(c("u")).alias("k")).collect()} == {"//example.com/story?a=1&b=2"}


def test_evergreen(spark):
    cases = [
        ("https://a.com/", True), ("https://a.com/en", True), ("https://a.com/en/news", True), ("https://a.com/blog", True),
        ("https://a.com/blog/post-1", False), ("https://a.com/x/about/y", True), ("nonsense", True), (None, True),
    ]
    df = spark.createDataFrame(cases, "u string, want boolean")
    for row in df.select("u", U.is_evergreen(c("u")).alias("got"), "want").collect():
        assert row.got == row.want, row.u


def test_strip_html(spark):
    html = "<p> a&amp;b <b>c</b></p><script>x</script><!-- no --><style>y</style>d"
    assert one(spark, T.strip_html(c("h")), h=html) == "a&b c d"


def test_blurb_clips_at_sentence(spark):
    text = "First sentence is here and goes on for a while so that the break falls late in the text. " * 4
    got = one(spark, T.clip_blurb(c("t")), t=text)
    assert got.endswith("...") and len(got) <= 243 and got.startswith("First sentence")


def test_editorial_rank(spark):
    rank = S.editorial_rank(c("m"), c("n"), c("i"), c("o"), c("t"))
    assert one(spark, rank, m=50.0, n=5, i=4, o=True, t=0.0) == 63.0
    assert one(spark, rank, m=50.0, n=0, i=0, o=False, t=20.0) == 48.0
    assert one(spark, rank, m=99.0, n=9, i=9, o=True, t=90.0) == 100.0


def test_final_score_is_bounded(spark):
    expr = S.final_score(c("r"), c("v"), c("k"), c("l"), c("s"), c("q"), c("u"))
    base = dict(k="x", l="unverified", s="community_signal", q=50.0, u="active")
    assert one(spark, expr, r=80.0, v=100.0, **base) == 89.0
    assert one(spark, expr, r=80.0, v=0.0, **base) == 60.0
    assert one(spark, expr, r=80.0, v=0.0, **{**base, "u": "retracted"}) == 40.0


def test_verification_mode(spark):
    cases = [
        ("https://arxiv.org/abs/1", "rss", "research_preprint"), ("https://github.com/a/b", "rss", "artifact"),
        ("https://github.com/topics/x", "rss", "reported_news"), ("https://openai.com/x", "rss", "official_statement"),
        ("https://doi.org/10.1", "rss", "research_published"), ("https://x.example/1", "hn", "community_post"),
    ]
    df = spark.createDataFrame(cases, "u string, k string, want string")
    for row in df.select("u", TR.verification_mode(c("u"), c("k")).alias("got"), "want").collect():
        assert row.got == row.want, row.u


def test_attribution(spark):
    got = one(spark, CD.attribution(c("k"), c("n"), c("u")), k="hn", n="Hacker News", u="https://www.my-site.co/x")
    assert (got.source, got.via) == ("My Site", "Hacker News")
    got = one(spark, CD.attribution(c("k"), c("n"), c("u")), k="rss", n="Feed", u="https://github.com/a")
    assert (got.source, got.via) == ("Feed", None)


def test_official_release(spark):
    got = one(
        spark, FT.release_assessment(c("t"), c("x"), c("u"), c("n")), t="Introducing GPT-9 Turbo",
        x="A new model for coding and reasoning with a longer context.", u="https://openai.com/index/gpt-9", n="OpenAI",
    )
    assert got.is_release and got.artifact_name == "GPT-9 Turbo" and got.source_entity == "OpenAI"


def test_mail_and_iso_times(spark):
    df = spark.createDataFrame([("Tue, 02 Jan 2024 10:00:00 GMT",), ("2024-01-02T10:00:00Z",), ("never",)], "t string")
    got = [r.x for r in df.select(F.unix_seconds(L._time(c("t"))).alias("x")).collect()]
    assert got == [1704189600, 1704189600, None]
