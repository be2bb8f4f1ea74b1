"""Text expressions: folding, wildcard search, tags, HTML text and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.schemas import COLORS, FAMILIES, STATUS_LABELS, TITLE_CHARS

#: White space as browsers and scripts see it: ASCII's, Unicode's separators and the byte order mark.
SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other letters as they are."""
    return F.translate(text, UPPER, LOWER)


def like_anywhere(text: Column, query: str) -> Column:
    """Whether the query, in which % and _ are wildcards, stands anywhere in the text; A-Z match either case.

    As a pattern: it folds A-Z while it looks, where a folded copy of each text would cost
    more. The parts between two % are found one after another, each at its first place after
    the part before, which is never given up again, so a text is passed once whatever the
    number of wildcards.
    """
    parts = ["".join("." if c == "_" else literal(c) for c in part) for part in query.strip().split("%") if part]
    return F.rlike(text, F.lit("(?is)" + (parts[0] if len(parts) == 1 else r"\A" + "".join(f"(?>.*?{part})" for part in parts))))


def literal(text: str) -> str:
    """The text as a pattern that matches just it."""
    return "".join(c if c.isalnum() or c == " " else f"\\x{{{ord(c):X}}}" for c in text)


def normalize_tag(label: Column) -> Column:
    """Trimmed, lower-cased, white space joined to one space, less one s at the end."""
    return F.regexp_replace(F.lower(clean_space(label)), "s$", "")


def clean_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def page_title(html: Column) -> Column:
    """The title element's text, entities decoded, at most TITLE_CHARS code points."""
    return F.left(clean_space(unescape_html(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(TITLE_CHARS))


def unescape_html(text: Column) -> Column:
    """The five common named entities and the non-breaking space."""
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def round_half_up(number: Column) -> Column:
    """Rounded to a whole number, halves upwards."""
    return F.floor(number + 0.5).cast("long")


def format_duration(ms: Column) -> Column:
    """Minutes and seconds, m:ss; null for null."""
    seconds = round_half_up(ms / 1000)
    shown = F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))
    return F.when(ms.isNotNull(), shown)


def format_bytes(size: Column) -> Column:
    """Gigabytes to one place, else whole megabytes, one at least; a dash for null and zero."""
    giga, mega = float(1 << 30), float(1 << 20)
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, F.lit("—"))
        .when(size > (1 << 30), F.concat(F.format_string("%.1f", size / giga), F.lit(" GB")))
        .otherwise(F.concat(F.greatest(F.lit(1), round_half_up(size / mega)).cast("string"), F.lit(" MB")))
    )


def status_label(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair]), status)


def color_token(color: Column) -> Column:
    """The colour if it is one of the palette's, else `muted`."""
    return F.when(color.isin(*COLORS), color).otherwise("muted")


def aspect(width: Column, height: Column) -> Column:
    """portrait, square or landscape; null without both sizes."""
    return F.when(width < height, "portrait").when(width == height, "square").when(width > height, "landscape")


def color_family(red: Column, green: Column, blue: Column) -> Column:
    """The family of a colour of 0-255 parts: black, white or grey by its lightness where it hardly has a hue, else by its strongest parts."""
    most, least = F.greatest(red, green, blue), F.least(red, green, blue)
    plain = F.when(most < 64, "black").when(least > 191, "white").otherwise("grey")
    strong = F.concat(*[F.when(2 * (part - least) > most - least, name).otherwise("") for part, name in ((red, "r"), (green, "g"), (blue, "b"))])
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair]), strong)
    return F.when(most - least < 32, plain).otherwise(named)


def counted(n: Column, noun: str) -> Column:
    """'1 mention', '2 mentions'."""
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {noun}")).otherwise(F.lit(f" {noun}s")))
