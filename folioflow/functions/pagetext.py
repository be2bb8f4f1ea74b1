"""The readable text of a page, found by the density of its blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import clean_space, unescape_html
from folioflow.schemas import PAGE_CHARS

#: Elements that are never text, elements that part blocks, headings, and names of what isn't the article.
HIDDEN = ("head", "script", "style", "noscript", "template", "svg", "nav", "footer", "aside", "form")
BLOCKS = (
    "address", "article", "blockquote", "body", "br", "caption", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h[1-6]", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
BESIDE = ("ad", "ads", "advert", "banner", "breadcrumb", "comment", "comments", "cookie", "footer", "menu", "nav", "navbar", "pager", "promo", "related", "share", "sidebar", "social", "sponsor")
#: What a block costs, what a character of link text costs, what a block costs that is named as beside the article; a run of a lower score is no article.
BLOCK_COST, LINK_COST, BESIDE_COST, LEAST = 25, 3, 400, 20

#: In the syntax that Java and RE2 share. No pattern can run over more than one element or up to the end of a hidden one.
HIDDEN_PATTERN = r"(?is)<!--.*?-->|" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in HIDDEN)
BLOCK_PATTERN = rf"(?is)(</?(?:{'|'.join(BLOCKS)})\b[^<>]*>)"
LINK_PATTERN = r"(?is)<a\b[^>]*>(.*?)</a\s*>"
HEADING_PATTERN = r"(?is)^<h[1-6]\b"
BESIDE_PATTERN = rf"(?is)^<[a-z0-9]+\b[^>]*\b(?:class|id|role)\s*=\s*[\"']?(?:[^\"'>]*[\s_-])?(?:{'|'.join(BESIDE)})(?:[\s_-][^\"'>]*)?[\"'\s>]"
MARK = "\x01"


def _plain(html: Column) -> Column:
    """Text without tags; a tag that never ends goes too."""
    return clean_space(unescape_html(F.regexp_replace(html, r"(?s)<[^>]*(?:>|$)", " ")))


def blocks(html: Column) -> Column:
    """array of (text, score, beside) of a page's blocks that have text, in order.

    A block begins at a tag that parts blocks. Its score is its number of characters, less
    LINK_COST for each of link text, less what a block costs (a heading costs nothing).
    """
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN_PATTERN, " ")
    cut = F.split(F.regexp_replace(F.replace(shown, F.lit(MARK), F.lit(" ")), BLOCK_PATTERN, f"{MARK}$1"), MARK)
    parts = F.transform(cut, lambda b: F.struct(_plain(b).alias("text"), b.alias("html")))
    parts = F.filter(parts, lambda b: b["text"] != "")

    def scored(b: Column) -> Column:
        links = F.length(_plain(F.array_join(F.regexp_extract_all(b["html"], F.lit(LINK_PATTERN), F.lit(1)), " ")))
        beside = F.rlike(b["html"], F.lit(BESIDE_PATTERN))
        cost = F.when(beside, BESIDE_COST).when(F.rlike(b["html"], F.lit(HEADING_PATTERN)), 0).otherwise(BLOCK_COST)
        return F.struct(b["text"].alias("text"), (F.length(b["text"]) - LINK_COST * links - cost).alias("score"), beside.alias("beside"))

    return F.transform(parts, scored)


def best_run(of: Column) -> Column:
    """The neighbouring blocks of greatest total score, the first of equal runs and of these the shortest: its total, and its first and last index from 0.

    By one pass over running sums: a run begins anew where what is before it adds nothing.
    """
    low = F.lit(-(1 << 60))
    start = F.struct(F.lit(0).alias("at"), low.alias("sum"), F.lit(0).alias("first"), low.alias("best"), F.lit(0).alias("from"), F.lit(-1).alias("to"))

    def step(a: Column, b: Column) -> Column:
        anew = a["sum"] <= 0
        total, first = F.when(anew, b["score"].cast("long")).otherwise(a["sum"] + b["score"]), F.when(anew, a["at"]).otherwise(a["first"])
        better = total > a["best"]
        return F.struct(
            (a["at"] + 1).alias("at"), total.alias("sum"), first.alias("first"), F.when(better, total).otherwise(a["best"]).alias("best"),
            F.when(better, first).otherwise(a["from"]).alias("from"), F.when(better, a["at"]).otherwise(a["to"]).alias("to"),
        )

    return F.aggregate(of, start, step, lambda a: F.struct(a["best"].alias("best"), a["from"].alias("from"), a["to"].alias("to")))


def page_text(html: Column) -> Column:
    """The readable text of a page, at most PAGE_CHARS code points: the best run of its blocks; empty for a page without text and for null.

    A page whose best run scores less than LEAST has no article: all of its blocks are its
    text, but those named as beside one. Comments, scripts, navigation and the like are left
    out first. A nav or form that never ends is read as text.
    """
    # the blocks are made once: an array of one is bound to a name
    read = F.transform(F.array(blocks(html)), lambda b: F.struct(b.alias("all"), best_run(b).alias("run")))

    def text(r: Column) -> Column:
        run = F.slice(r["all"], r["run"]["from"] + 1, r["run"]["to"] - r["run"]["from"] + 1)
        shown = F.when(r["run"]["best"] < LEAST, F.filter(r["all"], lambda b: ~b["beside"])).otherwise(run)
        return F.array_join(F.transform(shown, lambda b: b["text"]), " ")

    return F.left(F.get(F.transform(read, text), 0), F.lit(PAGE_CHARS))
