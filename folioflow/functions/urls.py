"""Links: parts, admissibility, platforms and canonical forms, in built-in functions.

Links are read as the URL standard reads them for http and https: white space at the
ends and tabs and line feeds inside are left out, back slashes count as slashes, dot
segments are resolved, characters that a path or query can't hold are percent-encoded
and hosts become their canonical form (`_with_host`). A link is parsed once, in a few
steps of one projection each, into a struct from which all else follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import SPACE

# Query parameters that only track, and hosts that are never fetched.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "igshid", "si", "feature", "ref")
PRIVATE_HOSTS = ("localhost", "localhost.localdomain", "metadata.google.internal", "metadata")
# What a rejected link is told.
INVALID = "Invalid URL"
NOT_HTTP = "Only HTTP(S) links are supported."
CREDENTIALS = "Links with embedded credentials are not allowed."
BAD_PORT = "Only ports 80 and 443 are supported."
PRIVATE = "Local and private destinations are not allowed."
NO_POST = {
    "youtube": "Paste an individual YouTube video or Short, not a channel or playlist.",
    "instagram": "Paste an individual Instagram post or Reel.",
    "tiktok": "Paste an individual TikTok video.",
    "x": "Paste an individual X post.",
}
PARTS = "parts"


def trimmed(url: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(url, f"^{SPACE}+|{SPACE}+$", "")


def _encoded(text: Column, bad: str) -> Column:
    """The characters of the class `bad` as percent-encoded UTF-8."""
    each = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(bad), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    return F.when(text.rlike(bad), F.array_join(each, "")).otherwise(text)


def _path_form(path: Column) -> Column:
    """Dot segments resolved, repeated slashes joined, none at the end; / if nothing is left."""
    none = F.array().cast("array<string>")

    def step(found: Column, part: Column) -> Column:
        up = F.slice(found, F.lit(1), F.greatest(F.lit(1), F.size(found) - 1))
        return F.when(F.lower(part).isin("..", ".%2e", "%2e.", "%2e%2e"), F.when(F.size(found) > 1, up).otherwise(found)).when(F.lower(part).isin(".", "%2e"), found).otherwise(F.array_append(found, part))

    resolved = F.when(path.rlike(r"(?i)/(\.|%2e)"), F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")).otherwise(path)
    short = F.regexp_replace(F.regexp_replace(_encoded(resolved, r"[^\x21\x24-\x3B\x3D\x40-\x5D\x5F\x61-\x7A\x7C\x7E]"), "/+", "/"), "/$", "")
    return F.when(short == "", "/").when(F.startswith(short, F.lit("/")), short).otherwise(F.concat(F.lit("/"), short))


def _number(part: Column) -> Column:
    """A part of an IPv4 address, decimal, 0x or 0 for hexadecimal or octal; null if it isn't one."""
    digits = F.concat(F.lit("0"), F.regexp_replace(part, "^0x?0*", ""))
    return (
        F.when(part.rlike("^[1-9][0-9]{0,9}$"), part)
        .when(part.rlike("^0x0*[0-9a-f]{0,8}$"), F.conv(digits, 16, 10))
        .when(part.rlike("^0[0-7]{0,12}$"), F.conv(digits, 8, 10))
    ).cast("long")


def _with_host(links: DataFrame, raw: str) -> DataFrame:
    """The rows with _host: a host as it would be asked for. Lower case, other letters in
    Punycode, addresses in any notation (1 to 4 parts, hexadecimal, octal; IPv6) in their
    one canonical form; null if it is no host.

    Each step is a projection of its own, so that no expression stands in another's place twice.
    """
    given, none = F.col(raw), F.array().cast("array<string>")
    tail = r"^(.*:)(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    decoded = F.when(F.contains(given, F.lit("%")), F.try_url_decode(F.replace(given, F.lit("+"), F.lit("%2B")))).otherwise(given)
    step = links.withColumns({"_name": decoded, "_six": F.when(F.startswith(given, F.lit("[")), F.lower(F.regexp_replace(given, r"^\[|\]$", "")))})
    name = F.when(F.col("_name").rlike(r"[^\x00-\x7F]"), F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), F.col("_name"))).otherwise(F.col("_name"))
    last = F.when(F.col("_six").rlike(tail), F.transform(F.array(*[F.regexp_extract("_six", tail, k) for k in (2, 3, 4, 5)]), lambda x: x.cast("int")))
    step = step.withColumns({"_name": F.lower(name), "_last": last})
    # IPv4: the numbers of the parts, of which the last fills what is left
    numeric = F.col("_name").rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$")
    pair = lambda k: F.lower(F.hex(F.col("_last")[k] * 256 + F.col("_last")[k + 1]))
    flat = F.when(F.col("_last").isNull(), F.col("_six")).when(F.array_max("_last") <= 255, F.concat(F.regexp_extract("_six", tail, 1), pair(0), F.lit(":"), pair(2)))
    step = step.withColumns({"_four": F.when(numeric, F.transform(F.split(F.regexp_replace("_name", r"\.$", ""), r"\."), _number)), "_halves": F.split(flat, "::")})
    n, end = F.size("_four"), F.element_at("_four", -1)
    front = F.slice("_four", F.lit(1), n - 1)
    ok = (n <= 4) & F.forall("_four", lambda p: p.isNotNull()) & F.forall(front, lambda p: p <= 255) & (end < F.pow(F.lit(256), 5 - n))
    value = F.aggregate(front, F.lit(0).cast("long"), lambda total, p: total * 256 + p) * F.pow(F.lit(256), 5 - n).cast("long") + end
    groups = lambda k: F.when(F.element_at("_halves", k) != "", F.split(F.element_at("_halves", k), ":")).otherwise(none)
    step = step.withColumns({"_value": F.when(ok, value), "_left": F.when(F.size("_halves") <= 2, groups(1)), "_right": F.when(F.size("_halves") == 2, groups(-1)).otherwise(none)})
    gap = 8 - F.size("_left") - F.size("_right")
    step = step.withColumn("_left", F.when(F.size("_halves") == 2, F.when(gap > 0, F.concat("_left", F.array_repeat(F.lit("0"), gap), "_right"))).otherwise(F.col("_left")))
    ok = (F.size("_left") == 8) & F.forall("_left", lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    full = F.array_join(F.transform("_left", lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")
    step = step.withColumn("_six", F.when(ok, F.concat(F.lit(":"), full, F.lit(":"))))
    # IPv6: the longest run of zeros, the first of equals, is left out
    runs = F.filter(F.transform(F.sequence(F.lit(8), F.lit(2), F.lit(-1)), lambda k: F.concat(F.lit(":"), F.repeat(F.lit("0:"), k))), lambda r: F.contains("_six", r))
    step = step.withColumn("_run", F.when(F.col("_six").isNotNull(), F.try_element_at(runs, F.lit(1))))
    rest = F.regexp_replace(F.substring("_six", F.instr("_six", F.col("_run")) + F.length("_run"), F.length("_six")), ":$", "")
    short = F.concat(F.substring("_six", F.lit(2), F.instr("_six", F.col("_run")) - 2), F.lit("::"), rest)
    whole = F.substring("_six", F.lit(2), F.length("_six") - 2)
    quad = F.concat_ws(".", *[F.shiftright("_value", k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)])
    odd = (F.col("_name") == "") | F.col("_name").rlike(r"[\x00-\x20\x7F#/:<>?@\[\\\]^|%]")
    host = (
        F.when(F.startswith(given, F.lit("[")), F.concat(F.lit("["), F.coalesce(short, whole), F.lit("]")))
        .when(F.col("_four").isNotNull(), F.when(F.col("_value").isNotNull(), quad))
        .when(~odd, F.col("_name"))
    )
    return step.withColumn("_host", host)


def is_private(host: Column) -> Column:
    """Whether a canonical host is local, private or link-local, by name or as an address."""
    bare = F.regexp_replace(host, r"^\[|\]$|\.$", "")
    mapped = r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
    high = F.when(bare.rlike(mapped), F.conv(F.regexp_extract(bare, mapped, 1), 16, 10).cast("int"))
    four = bare.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    a = F.when(four, F.split_part(bare, F.lit("."), F.lit(1)).cast("int")).otherwise(F.shiftright(high, 8))
    b = F.when(four, F.split_part(bare, F.lit("."), F.lit(2)).cast("int")).otherwise(high.bitwiseAND(255))
    own = a.isin(10, 127, 0) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    six = F.contains(bare, F.lit(":")) & (bare.isin("::1", "::") | bare.rlike("^(fc|fd|fe80:)"))
    return bare.isin(*PRIVATE_HOSTS) | bare.rlike(r"\.(localhost|local)$") | F.coalesce(own, F.lit(False)) | six


def _platform(host: Column) -> Column:
    return (
        F.when((host == "youtu.be") | F.endswith(host, F.lit("youtube.com")), "youtube")
        .when(F.endswith(host, F.lit("instagram.com")), "instagram")
        .when(F.endswith(host, F.lit("tiktok.com")), "tiktok")
        .when(host.rlike(r"^(.*\.)?(x|twitter)\.com$"), "x")
        .otherwise("web")
    )


def _form_decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def _post(platform: Column, host: Column, path: Column, query: Column) -> Column:
    """The post's id on its platform; null on the web or if there is none."""
    some = lambda text: F.nullif(text, F.lit(""))
    found = lambda pattern: some(F.regexp_extract(path, pattern, 1))
    asked = "(?:^|&)v=([^&]*)"
    video = F.when(query.rlike(asked), some(_form_decoded(F.regexp_extract(query, asked, 1)))).otherwise(found("/(?:shorts|embed|live)/([^/]+)"))
    return (
        F.when(platform == "youtube", F.when(host == "youtu.be", found("^/([^/]*)")).otherwise(video))
        .when(platform == "instagram", found("/(?:reel|p|tv)/([^/]+)"))
        .when(platform == "tiktok", found(r"/video/(\d+)"))
        .when(platform == "x", found(r"/status/(\d+)"))
    )


def _untracked(query: Column) -> Column:
    """The query less tracking parameters; if there were some, the rest is written anew as a form."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: F.substring_index(p, "=", 1)
    tracks = lambda p: _form_decoded(name(p)).isin(*TRACKING)
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")
    again = lambda text: F.url_encode(_form_decoded(text))
    kept = F.transform(F.filter(pairs, lambda p: ~tracks(p)), lambda p: F.concat(again(name(p)), F.lit("="), again(value(p))))
    return F.when(F.exists(pairs, tracks), F.nullif(F.array_join(kept, "&"), F.lit(""))).otherwise(_encoded(query, r"[^\x21\x24-\x26\x28-\x3B\x3D\x3F-\x7E]"))


def with_parts(links: DataFrame, url: str = "url") -> DataFrame:
    """The rows with a struct `parts`: scheme, host (null: none), private, platform, post, canonical, reason.

    reason is why a link isn't taken, null if it is; the canonical form is that by which
    links are compared: no fragment, no tracking parameters and, on other platforms than
    the web, no query at all; on YouTube the post's id as the path.
    """
    had = links.columns
    text = F.regexp_replace(trimmed(F.col(url)), r"[\t\n\r]|^[\x00-\x20]+|[\x00-\x20]+$", "")
    step = links.withColumn("_u", text)
    rest = r"^[A-Za-z]+:[/\\]*([^/\\?#]*)([^?#]*)"
    step = step.withColumns({
        "_scheme": F.lower(F.regexp_extract("_u", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)),
        "_authority": F.regexp_extract("_u", rest, 1),
        "_raw": F.translate(F.regexp_extract("_u", rest, 2), "\\", "/"),
        "_query": F.when(F.col("_u").rlike(r"^[^#]*\?"), F.regexp_extract("_u", r"^[^?#]*\?([^#]*)", 1)),
    })
    step = step.withColumns({
        "_user": F.regexp_extract("_authority", "^(.*)@", 1),
        "_at": F.regexp_extract(F.regexp_replace("_authority", "^.*@", ""), r"^(\[[^\]]*\]|[^:\[\]]*)(?::([0-9]*))?$", 1),
        "_gate": F.regexp_replace(F.regexp_extract(F.regexp_replace("_authority", "^.*@", ""), r"^(\[[^\]]*\]|[^:\[\]]*)(?::([0-9]*))?$", 2), "^0+(?=.)", ""),
        "_path": _path_form(F.col("_raw")),
    })
    web = F.col("_scheme").isin("http", "https")
    own = ((F.col("_scheme") == "http") & (F.col("_gate") == "80")) | ((F.col("_scheme") == "https") & (F.col("_gate") == "443"))
    step = _with_host(step.withColumns({"_at": F.when(web, F.col("_at")), "_gate": F.when(own, "").otherwise(F.col("_gate"))}), "_at")
    step = step.withColumns({"_kind": _platform(F.coalesce("_host", F.lit(""))), "_private": F.coalesce(is_private(F.col("_host")), F.lit(False))})
    step = step.withColumn("_post", _post(F.col("_kind"), F.col("_host"), F.col("_path"), F.coalesce("_query", F.lit(""))))
    missing = F.coalesce(*[F.when(F.col("_kind") == k, F.lit(v)) for k, v in NO_POST.items()])
    reason = (
        F.when(F.col(url).isNull() | (F.col("_scheme") == ""), INVALID)
        .when(~web, NOT_HTTP)
        .when(F.col("_host").isNull() | (F.length("_gate") > 5) | (F.coalesce(F.col("_gate").try_cast("int"), F.lit(0)) > 65535), INVALID)
        .when(~F.col("_user").isin("", ":"), CREDENTIALS)
        .when(~F.col("_gate").isin("", "80", "443"), BAD_PORT)
        .when(F.col("_private"), PRIVATE)
        .when((F.col("_kind") != "web") & F.col("_post").isNull(), missing)
    )
    gate = F.when(F.col("_gate") == "", "").otherwise(F.concat(F.lit(":"), F.col("_gate")))
    at = F.when(F.col("_kind") == "youtube", F.concat(F.lit("/"), _encoded(F.col("_post"), r"[^\x21\x24-\x3B\x3D\x40-\x5D\x5F\x61-\x7A\x7C\x7E]"))).otherwise(F.col("_path"))
    asked = F.when(F.col("_kind") == "web", F.coalesce(F.concat(F.lit("?"), _untracked(F.col("_query"))), F.lit(""))).otherwise("")
    step = step.withColumns({"_reason": reason, "_canonical": F.concat(F.col("_scheme"), F.lit("://"), F.col("_host"), gate, at, asked)})
    parts = F.struct(*[F.col(f"_{c}").alias(c) for c in ("scheme", "host", "private")], F.col("_kind").alias("platform"), *[F.col(f"_{c}").alias(c) for c in ("post", "canonical", "reason")])
    # one row from an array of one: filters on the parts stay above it, instead of standing in for every step below
    return step.select(*had, F.explode(F.array(parts)).alias(PARTS))
