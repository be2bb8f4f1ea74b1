import ipaddress

import hypothesis.strategies as st
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F

from folioflow.functions import pagetext, text, urls, vectors
from folioflow.operators.ingest import admit
from folioflow.plans.links import LINKS, links


def admitted(spark, *links):
    rows = admit(spark.createDataFrame([(u,) for u in links], "url string")).collect()
    return [(r.platform, r.platform_id, r.canonical_url, r.reject_reason) for r in rows]


def test_links(spark):
    """The list's links become what is written beside them, all in one pass."""
    got = {r.place: r for r in admit(spark.createDataFrame(links(), "place long, url string")).collect()}
    for (place, url), (_, host, platform, post, canonical, reason) in zip(links(), LINKS, strict=True):
        r = got[place]
        assert (url, r.host, r.platform, r.platform_id, r.canonical_url, r.reject_reason) == (url, host, platform, post, canonical, reason)


def test_links_beside_other_columns(spark):
    rows = spark.createDataFrame([("https://a.example/x", "was", 1)], "url string, platform string, parts int")
    got = admit(rows.withColumnRenamed("parts", "part")).first()
    assert (got.platform, got.part, got.canonical_url) == ("web", 1, "https://a.example/x")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=40), st.lists(st.integers(0, 2**128 - 1).map(lambda n: n & ~(0xFFFF << 48) & ~(0xFFFF << 64)), min_size=1, max_size=40))
def test_addresses_have_one_form(spark, fours, sixes):
    said = [(str(ipaddress.IPv4Address(n)), w) for n in fours for w in (str(n), hex(n), f"{n >> 24}.{n & 0xFFFFFF}", f"0{n >> 24:o}.{n >> 16 & 255}.{n & 0xFFFF}")]
    said += [(f"[{ipaddress.IPv6Address(n)}]", f"[{w}]") for n in sixes for w in (ipaddress.IPv6Address(n).exploded, ipaddress.IPv6Address(n).compressed.upper())]
    rows = spark.createDataFrame([(f"http://{w}/",) for _, w in said], "url string")
    got = {r.url: r.host for r in urls.with_parts(rows).select("url", "parts.host").collect()}
    assert all(got[f"http://{w}/"] == want for want, w in said)


def test_private_hosts(spark):
    hosts = ["192.168.1.20", "10.0.0.1", "172.31.0.1", "172.32.0.1", "8.8.8.8", "printer.local", "example.com", "fd00::1", "[fe80::1]", "fdomain.com"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", urls.is_private(F.col("h")).alias("p")).collect()
    assert [r.h for r in rows if r.p] == ["192.168.1.20", "10.0.0.1", "172.31.0.1", "printer.local", "fd00::1", "[fe80::1]"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["http", "https"]), st.from_regex(r"[a-zA-Z]{1,8}\.(com|org)", fullmatch=True), st.from_regex(r"(/[a-z0-9]{0,4}){0,4}", fullmatch=True), st.from_regex(r"(\?([a-z]{1,3}=[0-9]{0,2}&?){1,3})?", fullmatch=True)), min_size=1, max_size=30))
def test_canonical_form_is_stable(spark, parts):
    once = [r[2] for r in admitted(spark, *["://".join((a, b)) + c + d for a, b, c, d in parts])]
    assert [r[2] for r in admitted(spark, *[u for u in once if u])] == [u for u in once if u]


def test_text(spark):
    rows = spark.createDataFrame([("\u00a0 Web \u2003  Designs\t", 61499, 5 << 20, "Ünïque KEY"), (None, None, None, None), ("s", 59500, 3 << 30, "a_b%c")], "t string, ms long, b long, x string")
    got = rows.select(text.normalize_tag(F.col("t")), text.format_duration(F.col("ms")), text.format_bytes(F.col("b")), text.like_anywhere(F.col("x"), " key "), text.like_anywhere(F.col("x"), "_b%")).collect()
    assert [tuple(r) for r in got] == [("web design", "1:01", "5 MB", True, False), (None, None, "—", None, None), ("", "1:00", "3.0 GB", False, True)]


def test_page_text(spark):
    html = "<html><head><title> A &amp; B </title><style>x{}</style></head><body><nav>menu</nav><article><h1>Hi</h1><script>no()</script><p>one<br>two &lt;3</p></article><footer>end</footer></body></html>"
    row = spark.createDataFrame([(html,)], "h string").select(text.page_title(F.col("h")).alias("t"), pagetext.page_text(F.col("h")).alias("b")).first()
    assert (row.t, row.b) == ("A & B", "Hi one two <3")


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], list(range(72)), list(range(72, 0, -1)))], "a array<double>, b array<double>, p array<int>, q array<int>")
    got = row.select(vectors.cosine(F.col("a"), F.col("b")), vectors.difference_hash(F.col("p")), vectors.difference_hash(F.col("q")), vectors.hamming(F.lit(5), F.lit(6))).first()
    assert abs(got[0] - 0.96) < 1e-12 and tuple(got)[1:] == (0, -1, 2)


def test_colors_and_shapes(spark):
    rows = [(10, 10, 10, 3, 4), (250, 240, 245, 4, 4), (120, 121, 119, 5, 4), (200, 20, 30, None, 1), (200, 190, 10, 1, 2), (10, 90, 250, 1, 2), (None, 1, 1, 1, 1)]
    got = spark.createDataFrame(rows, "r int, g int, b int, w int, h int").select(text.color_family(F.col("r"), F.col("g"), F.col("b")), text.aspect(F.col("w"), F.col("h"))).collect()
    assert [r[0] for r in got[:6]] == ["black", "white", "grey", "red", "yellow", "blue"] and [r[1] for r in got] == ["portrait", "square", "landscape", None, "portrait", "portrait", "square"]
    tokens = spark.createDataFrame([("plum",), ("x",), (None,)], "c string").select(text.color_token(F.col("c"))).collect()
    assert [r[0] for r in tokens] == ["plum", "muted", "muted"]
