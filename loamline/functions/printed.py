"""Column expressions over text taken from printed pages: glyph marks, headings, joined lines, page ranges, cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ratios of sizes that make headings of level 1 to 3, longest heading, marks that end a sentence.
HEADING_RATIOS = [2.0, 1.55, 1.25]
HEADING_CHARS, TITLE_CHARS = 200, 60
SENTENCE_END = r"[.,;:?!)\]]$"
#: What a cut text may end at, in order of preference.
BREAKS = [[". ", "! ", "? ", "。", "！", "？"], ["; ", " - ", ", ", ": ", " (", "；", "，", "："], [" "]]
GLYPH = r"\(cid:[0-9]+\)"


def glyph_share(text: Column) -> Column:
    """The share of a text that is marks of glyphs without a character; 0 for an empty text."""
    marks = F.length(text) - F.length(F.regexp_replace(text, GLYPH, ""))
    return F.when(F.length(text) > 0, marks / F.length(text)).otherwise(0.0)


def readable_share(text: Column) -> Column:
    """Printable characters besides glyph marks, as a share of the text with them."""
    clean = F.regexp_replace(F.regexp_replace(text, GLYPH, ""), r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", "")
    return F.when(F.length(text) > 0, F.length(clean) / F.length(text)).otherwise(0.0)


def is_numbered_title(line: Column) -> Column:
    """A short line that begins with a section number and does not end a sentence."""
    t = F.trim(line)
    return (F.length(t) <= TITLE_CHARS) & ~t.rlike(SENTENCE_END) & t.rlike(r"^[0-9]{1,2}(\.[0-9]{1,2})*\.?\s+\S")


def heading_level(line_size: Column, body_size: Column, bold: Column, line: Column) -> Column:
    """0 for no heading, else its level by the ratio of sizes; a bold one is a level higher."""
    t, ratio = F.trim(line), line_size / body_size
    level = F.coalesce(*[F.when(ratio >= r, F.lit(k + 1)) for k, r in enumerate(HEADING_RATIOS)], F.lit(0))
    usable = (body_size > 0) & (line_size > 0) & (t != "") & (F.length(t) <= HEADING_CHARS) & ~t.rlike(SENTENCE_END)
    return F.when(usable, F.when(bold & (level > 1), level - 1).otherwise(level)).otherwise(0)


def joined_lines(text: Column) -> Column:
    """The lines as one, without the hyphen where a word goes on in lower case."""
    lines = F.array_join(F.filter(F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    return F.replace(F.regexp_replace(lines, r"([\p{L}\p{N}])-\n(\p{Ll})", "$1$2"), F.lit("\n"), F.lit(" "))


def page_numbers(spec: Column, total: Column) -> Column:
    """Pages of '1-5', '1,3,5-7', sorted, distinct and within 1 to ``total``; all for an empty one; odd parts are skipped."""
    ends = lambda x, k: F.regexp_extract(F.trim(x), r"^([0-9]{1,9})\s*(?:-\s*([0-9]{1,9}))?$", k)

    def pages(x: Column) -> Column:
        a = ends(x, 1).try_cast("int")
        b = F.coalesce(ends(x, 2).try_cast("int"), a)
        low, high = F.greatest(F.lit(1), F.least(a, b)), F.least(total, F.greatest(a, b))
        return F.when(a.isNotNull() & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    listed = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), pages))))
    every = F.when(total >= 1, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>"))
    return F.when(spec.isNull() | (F.trim(spec) == ""), every).otherwise(listed)


def cut_length(head: Column, keep_mark: bool = False) -> Column:
    """Characters to keep so that a text ends at its last sentence, else clause, else word; all where it has no break."""
    choices = []
    for marks in BREAKS:
        found = [
            F.when(
                F.contains(head, F.lit(m)),
                F.struct((F.length(head) - F.instr(F.reverse(head), m[::-1]) - len(m) + 1).alias("at"), F.lit(-k).alias("k"), F.lit(len(m)).alias("n")),
            )
            for k, m in enumerate(marks)
        ]
        last = F.array_max(F.array_compact(F.array(*found)))
        choices.append(F.when(last["at"] > 0, last["at"] + (last["n"] if keep_mark else 0)))
    return F.coalesce(*choices, F.length(head)).cast("int")


def delimiter(text: Column) -> Column:
    """The one of , ; tab and | that most lines of the text's first 8192 characters have equally often; else a comma."""
    lines = F.filter(F.split(F.substring(text, 1, 8192), "\r\n|\r|\n"), lambda x: F.trim(x) != "")

    def even(mark: str) -> Column:
        counts = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit(""))))
        return F.when((F.size(counts) > 0) & (F.array_min(counts) > 0) & (F.array_min(counts) == F.array_max(counts)), F.lit(mark))

    return F.coalesce(*[even(m) for m in (",", ";", "\t", "|")], F.lit(","))
