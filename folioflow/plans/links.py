"""A list of links with what each must become, written by hand from the rules of admission."""

from __future__ import annotations

from folioflow.functions.urls import BAD_PORT, CREDENTIALS, INVALID, NO_POST, NOT_HTTP, PRIVATE

_N = NO_POST


def _web(url: str, host: str, canonical: str) -> tuple:
    return url, host, "web", None, canonical, None


def _post(url: str, host: str, platform: str, post: str, canonical: str) -> tuple:
    return url, host, platform, post, canonical, None


def _no(url: str | None, host: str | None, reason: str) -> tuple:
    return url, host, None, None, None, reason


#: url, host, platform, post, canonical form, reason of rejection.
LINKS = (
    _post("https://www.youtube.com/watch?v=clip1&utm_source=mail", "www.youtube.com", "youtube", "clip1", "https://www.youtube.com/clip1"),
    _post("https://youtu.be/clip1", "youtu.be", "youtube", "clip1", "https://youtu.be/clip1"),
    _post("https://www.youtube.com/shorts/brief9/", "www.youtube.com", "youtube", "brief9", "https://www.youtube.com/brief9"),
    _post("https://m.youtube.com/live/now4?feature=x", "m.youtube.com", "youtube", "now4", "https://m.youtube.com/now4"),
    _no("https://www.youtube.com/channel/c1", "www.youtube.com", _N["youtube"]),
    _no("https://www.youtube.com/embed/e1?v=", "www.youtube.com", _N["youtube"]),
    _post("https://www.instagram.com/reel/Shot_7/?igshid=q", "www.instagram.com", "instagram", "Shot_7", "https://www.instagram.com/reel/Shot_7"),
    _post("https://instagram.com/p/Q1", "instagram.com", "instagram", "Q1", "https://instagram.com/p/Q1"),
    _no("https://www.instagram.com/someone/", "www.instagram.com", _N["instagram"]),
    _post("https://www.tiktok.com/@me/video/12345?lang=en", "www.tiktok.com", "tiktok", "12345", "https://www.tiktok.com/@me/video/12345"),
    _no("https://www.tiktok.com/@me", "www.tiktok.com", _N["tiktok"]),
    _post("https://x.com/me/status/99", "x.com", "x", "99", "https://x.com/me/status/99"),
    _post("https://twitter.com/me/status/99?s=20", "twitter.com", "x", "99", "https://twitter.com/me/status/99"),
    _no("https://mobile.twitter.com/me", "mobile.twitter.com", _N["x"]),
    _post("https://notyoutube.com/watch?v=q1", "notyoutube.com", "youtube", "q1", "https://notyoutube.com/q1"),
    _web("https://shop.example/goods/7?utm_term=autumn&size=m", "shop.example", "https://shop.example/goods/7?size=m"),
    _web("https://SHOP.example//goods///7/?ref=a&size=m#top", "shop.example", "https://shop.example/goods/7?size=m"),
    _web("https://shop.example:443/a", "shop.example", "https://shop.example/a"),
    _web("http://shop.example:443/a", "shop.example", "http://shop.example:443/a"),
    _web("http://shop.example:0080/a", "shop.example", "http://shop.example/a"),
    _web("  https://books.example/cut?a=1&a=2  ", "books.example", "https://books.example/cut?a=1&a=2"),
    _web("https://books.example", "books.example", "https://books.example/"),
    _web("https://books.example/", "books.example", "https://books.example/"),
    _web("https://books.example/?", "books.example", "https://books.example/?"),
    _web("https://books.example/?ref=1", "books.example", "https://books.example/"),
    _web("https://books.example/a/./b/../c d", "books.example", "https://books.example/a/c%20d"),
    _web("https://books.example/x?q=café au&si=1&n", "books.example", "https://books.example/x?q=caf%C3%A9+au&n="),
    _web("https:\\\\books.example\\shelf", "books.example", "https://books.example/shelf"),
    _web("https:///books.example/shelf", "books.example", "https://books.example/shelf"),
    _web("http://bücher.example/", "xn--bcher-kva.example", "http://xn--bcher-kva.example/"),
    _web("https://@books.example/", "books.example", "https://books.example/"),
    _web("http://172.32.9.9/", "172.32.9.9", "http://172.32.9.9/"),
    _web("http://0x08080808/", "8.8.8.8", "http://8.8.8.8/"),
    _web("http://[2001:DB8:0:0:1:0:0:1]/p", "[2001:db8::1:0:0:1]", "http://[2001:db8::1:0:0:1]/p"),
    _no("https://shop.example:8080/a", "shop.example", BAD_PORT),
    _no("https://shop.example:99999/a", "shop.example", INVALID),
    _no("https://me:pw@shop.example/a", "shop.example", CREDENTIALS),
    _no("ftp://shop.example/a", None, NOT_HTTP),
    _no("not a link", None, INVALID),
    _no("", None, INVALID),
    _no(None, None, INVALID),
    _no("http://", None, INVALID),
    _no("http://a b/", None, INVALID),
    _no("http://1.2.3.4.5/", None, INVALID),
    _no("http://300.1.1.1/", None, INVALID),
    _no("http://[1::2::3]/", None, INVALID),
    _no("http://127.0.0.1/", "127.0.0.1", PRIVATE),
    _no("http://127.0.0.1./", "127.0.0.1", PRIVATE),
    _no("http://127.1/", "127.0.0.1", PRIVATE),
    _no("http://0x7f.1/", "127.0.0.1", PRIVATE),
    _no("http://0177.0.0.1/", "127.0.0.1", PRIVATE),
    _no("http://2130706433/", "127.0.0.1", PRIVATE),
    _no("http://%31%30.1.2.3/", "10.1.2.3", PRIVATE),
    _no("http://172.16.9.9/", "172.16.9.9", PRIVATE),
    _no("http://192.168.1.20/", "192.168.1.20", PRIVATE),
    _no("http://169.254.1.1/", "169.254.1.1", PRIVATE),
    _no("http://0/", "0.0.0.0", PRIVATE),
    _no("http://[::1]/", "[::1]", PRIVATE),
    _no("http://[0:0:0:0:0:0:0:1]/", "[::1]", PRIVATE),
    _no("http://[0::0]/", "[::]", PRIVATE),
    _no("http://[::ffff:10.0.0.1]/", "[::ffff:a00:1]", PRIVATE),
    _no("http://[FE80::1]/x", "[fe80::1]", PRIVATE),
    _no("http://[fd00::2]/", "[fd00::2]", PRIVATE),
    _no("http://LocalHost/", "localhost", PRIVATE),
    _no("http://localhost./", "localhost.", PRIVATE),
    _no("http://printer.local/", "printer.local", PRIVATE),
    _no("http://a.localhost/x", "a.localhost", PRIVATE),
    _no("http://metadata.google.internal/", "metadata.google.internal", PRIVATE),
)


def links() -> list[tuple[int, str | None]]:
    """place (negative, so that pages can follow) and url."""
    return [(k - len(LINKS), row[0]) for k, row in enumerate(LINKS)]


def expected_sql() -> str:
    """place, url, host, platform, platform_id, canonical_url, reject_reason of the links, as a DuckDB table."""

    def said(value: str | None) -> str:
        return "NULL::VARCHAR" if value is None else "'" + value.replace("'", "''") + "'"

    rows = ", ".join(f"({k - len(LINKS)}::BIGINT, {', '.join(map(said, row))})" for k, row in enumerate(LINKS))
    return f"SELECT * FROM (VALUES {rows}) AS t(place, url, host, platform, platform_id, canonical_url, reject_reason)"
