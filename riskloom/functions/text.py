"""Text expressions; all run inside the JVM over whole texts."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns, word lists and cut-offs below define the results.
TAGS = r"<[^>]+>"
NOT_TEXT = r"""[^\p{L}\p{N}_\s.,!?;:()\-'"$%]"""
SPACES = r"\s+"
FILING_ARTEFACTS = [
    r"table of contents",
    r"page \d+",
    r"form 10-[kq]",
    r"item \d+[a-z]*\.",
    r"\.{3,}",
    r"-{3,}",
    r"pursuant to section",
    r"securities exchange act",
    r"commission file number",
]
STOP_WORDS = """
the a an and or but in on at to for of with by from up about into through during before after above below
between among this that these those i me my myself we our ours ourselves you your yours yourself he him his
himself she her hers herself it its itself they them their theirs themselves what which who whom is are was
were be been being have has had having do does did doing will would could should may might must can shall
""".split()
SECTION_PATTERNS = {
    "mda": [
        r"(item\s*[27]\.?\s*management'?s\s*discussion\s*and\s*analysis.*?)(item\s*[38]|\n\s*item|\z)",
        r"(management'?s\s*discussion\s*and\s*analysis.*?)(risk\s*factors|\n\s*item|\z)",
        r"(md&a.*?)(risk\s*factors|\n\s*item|\z)",
    ],
    "risk_factors": [
        r"(item\s*1a\.?\s*risk\s*factors.*?)(item\s*[12b]|\n\s*item|\z)",
        r"(risk\s*factors.*?)(unresolved\s*staff\s*comments|\n\s*item|\z)",
        r"(business\s*risks.*?)(\n\s*item|\z)",
    ],
}
SECTION_TITLES = ["Management's Discussion and Analysis", "MD&A", "Risk Factors", "Business Risks", "Risk Management"]
STOP_TITLES = ["item 2", "item 3", "item 4", "controls and procedures"]
HEADER_LENGTH = 200
MIN_NEWS_WORDS = 5
MIN_FILING_WORDS = 100
TOP_KEYWORDS = 20


def clean_text(c: Column) -> Column:
    """Drop tags and special characters, collapse white space; null becomes ''."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), TAGS, " ")
    c = F.regexp_replace(c, NOT_TEXT, " ")
    return F.trim(F.regexp_replace(c, SPACES, " "))


def clean_filing_text(c: Column) -> Column:
    c = clean_text(c)
    for p in FILING_ARTEFACTS:
        c = F.regexp_replace(c, f"(?i){p}", " ")
    return F.trim(F.regexp_replace(c, SPACES, " "))


def tidy(c: Column) -> Column:
    """White space of an article field; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " "))


def tidy_section(c: Column) -> Column:
    c = F.regexp_replace(c, SPACES, " ")
    c = F.regexp_replace(c, r"(?i)page\s+\d+", "")
    c = F.regexp_replace(c, r"(?i)table\s+of\s+contents", "")
    c = F.regexp_replace(c, r"\.{3,}", "...")
    return F.trim(F.regexp_replace(c, r"-{3,}", "---"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def piece_count(c: Column, separator: str) -> Column:
    return F.size(F.split(c, separator, -1))


def combined(*cols: Column) -> Column:
    return F.trim(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols]))


def html_to_text(c: Column) -> Column:
    """Readable text of a page; plain text passes through unchanged."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?is)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|li|ul|tr|h[1-6]|article|section|table)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.when(F.lower(c).contains("<html"), t).otherwise(c)


def first_section(text: Column, patterns: Sequence[str]) -> Column:
    """Tidied group 1 of the first pattern that matches, else null."""
    hits = [F.regexp_extract(text, f"(?is){p}", 1) for p in patterns]
    return tidy_section(F.coalesce(*[F.when(h != "", h) for h in hits]))


def extract_sections(df: DataFrame, content: str, out: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds ``<name>_text``, ``<name>_length`` and ``extraction_success``.

    A text in which no pattern finds a section is scanned by header lines instead: a block whose name is
    wanted becomes that section, and any block at all counts as success. Null gives empty sections.
    """
    wanted = out or SECTION_PATTERNS
    df = df.withColumn("_text", html_to_text(F.col(content)))
    df = df.withColumns({f"{n}_text": F.coalesce(first_section(F.col("_text"), ps), F.lit("")) for n, ps in wanted.items()})
    found = reduce(operator.or_, [F.length(f"{n}_text") > 0 for n in wanted])
    blocks = F.when(~found, header_blocks(F.col("_text")))  # null where a pattern matched: the fold is not run there
    df = df.withColumns({"_found": found, "_blocks": blocks})
    df = df.withColumns({f"{n}_text": F.when(F.col("_found"), F.col(f"{n}_text")).otherwise(F.coalesce(F.element_at("_blocks", F.lit(n)), F.lit(""))) for n in wanted})
    df = df.withColumns({f"{n}_length": F.length(f"{n}_text") for n in wanted})
    return df.withColumn("extraction_success", F.col("_found") | (F.coalesce(F.size("_blocks"), F.lit(0)) > 0)).drop("_text", "_found", "_blocks")


def header_blocks(text: Column) -> Column:
    """Section name -> its lines: those under a short header line, up to and including a stop line.

    One fold over the lines of the text, inside the row. The state has a fixed size: the open section, its first
    line, the line reached, and the first and last line of each section's latest block; texts are cut out at the end.
    Blank lines do not count. Null and texts without a header give an empty map.
    """
    names = [(t.lower(), t.lower().replace("'", "").replace(" ", "_")) for t in SECTION_TITLES]
    nothing = F.lit(-1)
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")

    def step(state: Column, line: Column) -> Column:
        low, at = F.lower(line), state["at"]
        title = F.coalesce(*[F.when(low.contains(t), F.lit(k)) for k, (t, _) in enumerate(names)], nothing)
        head = F.when(F.length(line) < HEADER_LENGTH, title).otherwise(nothing)
        # a header closes the open block in front of it
        before = F.when(head >= 0, _closed(state["blocks"], state["open"], state["first"], at - 1)).otherwise(state["blocks"])
        opened = F.when(head >= 0, head).otherwise(state["open"])
        first = F.when(head >= 0, at).otherwise(state["first"])
        stop = (opened >= 0) & reduce(operator.or_, [low.contains(t) for t in STOP_TITLES])
        return F.struct((at + 1).alias("at"), F.when(stop, nothing).otherwise(opened).alias("open"), first.alias("first"),
                        F.when(stop, _closed(before, opened, first, at)).otherwise(before).alias("blocks"))

    empty = F.array(*[F.struct(nothing.alias("first"), nothing.alias("last"))] * len(names))
    start = F.struct(F.lit(1).alias("at"), nothing.alias("open"), nothing.alias("first"), empty.alias("blocks"))

    def cut(ls: Column) -> Column:
        blocks = F.aggregate(ls, start, step, lambda st: _closed(st["blocks"], st["open"], st["first"], st["at"] - 1))
        named = F.zip_with(F.array(*[F.lit(n) for _, n in names]), blocks, lambda n, b: F.struct(
            n.alias("k"), F.when(b["first"] > 0, F.array_join(F.slice(ls, b["first"], b["last"] - b["first"] + 1), "\n")).alias("v")))
        return F.map_from_entries(F.filter(named, lambda e: e["v"].isNotNull()))

    return F.transform(F.array(lines), cut)[0]  # binds the lines once


def _closed(blocks: Column, which: Column, first: Column, last: Column) -> Column:
    """``blocks`` with the block of section ``which`` replaced (-1: unchanged)."""
    return F.transform(blocks, lambda b, k: F.when(k == which, F.struct(first.alias("first"), last.alias("last"))).otherwise(b))


def header_sections(df: DataFrame, key: str, content: str) -> DataFrame:
    """``key, section, text`` of the header scan, one row per section found (see ``header_blocks``)."""
    return df.select(key, F.explode(header_blocks(html_to_text(F.col(content)))).alias("section", "text"))


def keywords(df: DataFrame, key: str, text: str, top: int = TOP_KEYWORDS) -> DataFrame:
    """Most frequent words of each text: over 3 characters, no stop words; ties by first place.

    The texts are shuffled once, by key; counting and ranking their words follow in place.
    """
    words = df.select(key, text).repartition(key).select(key, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0))).alias("place", "word"))
    words = words.where((F.length("word") > 3) & ~F.col("word").isin(STOP_WORDS))
    counts = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "first_place")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(key, "word", "n", "rank")
