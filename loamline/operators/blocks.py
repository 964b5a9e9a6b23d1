"""Lines and blocks of texts: folding of repeated lines, splitting into blocks, running furniture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.text import FENCE, STRUCTURAL, furniture_key

#: Lines shorter than this, and texts of more lines, are left as they are.
SHORT_LINE, MANY_LINES = 24, 20_000


def numbered_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, line, fence (the line opens or closes code), inside (of code)."""
    rows = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    rows = rows.withColumn("fence", F.col("line").rlike(FENCE))
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("inside", F.sum(F.col("fence").cast("int")).over(upto) % 2 == 1)


def fold_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, dropped: the second and later copies of a line go.

    Short lines, structure (headings, lists, quotes, tables) and code stay, as does everything in very long texts.
    """
    rows = numbered_lines(df, key, text)
    stripped = F.trim(F.col("line"))
    plain = ~F.col("fence") & ~F.col("inside") & (F.length(stripped) >= SHORT_LINE) & ~F.col("line").rlike(STRUCTURAL)
    rows = rows.withColumns({"body": F.when(plain, stripped)})
    same = Window.partitionBy(key, "body").orderBy("pos")
    rows = rows.withColumn("again", F.col("body").isNotNull() & (F.row_number().over(same) > 1))
    rows = rows.withColumn("again", F.col("again") & (F.max("pos").over(Window.partitionBy(key)) < MANY_LINES))
    kept = F.array_sort(F.collect_list(F.when(~F.col("again"), F.struct("pos", "line"))))
    out = rows.groupBy(key).agg(kept.alias("kept"), F.count_if("again").alias("dropped"))
    return out.select(key, F.array_join(F.transform("kept", lambda x: x["line"]), "\n").alias("text"), "dropped")


def split_blocks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, block_id, kind, level, block: headings, code, tables, lists and paragraphs in order."""
    rows = numbered_lines(df, key, text)
    order = Window.partitionBy(key).orderBy("pos")
    line, blank = F.col("line"), F.trim(F.col("line")) == ""
    code = F.col("inside") | F.col("fence")
    kind = (
        F.when(code, "code").when(blank, "blank").when(line.rlike(r"^#{1,6}( |$)"), "heading").when(line.rlike(r"^\s*\|"), "table")
        .when(line.rlike(r"^\s*([-*+]|\d+[.)])\s"), "list").otherwise("text")
    )
    rows = rows.withColumn("kind", kind)
    before = F.lag("kind").over(order)
    starts = before.isNull() | (F.col("kind") != before) | (F.col("kind") == "heading")
    rows = rows.withColumn("starts", starts.cast("int"))
    rows = rows.withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = rows.where("kind <> 'blank'").groupBy(key, "run", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    blocks = blocks.withColumn("block_id", F.row_number().over(Window.partitionBy(key).orderBy("run")) - 1)
    block = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(block, "^(#+)", 1))).otherwise(99)
    return blocks.select(key, "block_id", "kind", level.alias("level"), block.alias("block"))


def running_furniture(df: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """key, side, line_key, pages: first or last lines that at least two pages of a document share, digits apart."""
    rows = df.select(key, page, F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "").alias("l")).where(F.size("l") > 0)
    edge = F.explode(F.array(F.struct(F.lit("head").alias("side"), F.element_at("l", 1).alias("line")), F.struct(F.lit("foot").alias("side"), F.element_at("l", -1).alias("line"))))
    rows = rows.select(key, page, edge.alias("e")).select(key, page, "e.side", furniture_key(F.col("e.line")).alias("line_key"), F.col("e.line").alias("line"))
    rows = rows.where((F.length("line") <= 120) & ~F.col("line").startswith("#"))
    return rows.groupBy(key, "side", "line_key").agg(F.countDistinct(page).alias("pages")).where("pages >= 2")
