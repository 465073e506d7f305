"""Placed characters as a relation, and lines and blocks of them by windows.

chars(key, page, seq, c, x, y, dx, dy, size, advance): each character looks at
the one before it on its page, is dropped, breaks the line or is joined, and a
running sum numbers the lines; lines look at the line before them in the same
way. One sort by (key, page, seq) serves all of it. Where three strikes of a
character follow each other the kernel in sources.stext compares with the last
kept one, the window with the last one; both drop the later strikes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docframe.sources.stext import LINE_GAP, LINE_STEP, SAME_WAY, STRUCK_TWICE, WORD_GAP

CHARS = "page int, seq int, c string, x double, y double, dx double, dy double, size double, advance double"


def lines(chars: DataFrame, key: str) -> DataFrame:
    """(key, page, line, text, size, x0, y0, x1, y1, dx, dy, first_x, first_y); lines of white space are dropped."""
    w = Window.partitionBy(key, "page").orderBy("seq")
    p = F.lag(F.struct("c", "x", "y", "dx", "dy", "advance")).over(w)
    col = F.col
    same = col("p.dx") * col("dx") + col("p.dy") * col("dy") >= SAME_WAY
    near = STRUCK_TWICE * F.least("advance", "p.advance")
    ex, ey = col("p.x") + col("p.dx") * col("p.advance"), col("p.y") + col("p.dy") * col("p.advance")
    along = (col("x") - ex) * col("dx") + (col("y") - ey) * col("dy")
    across = (col("y") - ey) * col("dx") - (col("x") - ex) * col("dy")
    struck = same & (col("c") == col("p.c")) & (F.abs(col("x") - col("p.x")) <= near) & (F.abs(col("y") - col("p.y")) <= near)
    seen = chars.withColumn("p", p).withColumn("struck", F.coalesce(struck, F.lit(False))).where("NOT struck")
    seen = seen.withColumn("p", p)  # against what is left
    breaks = col("p").isNull() | ~same | (F.abs(across) > LINE_GAP * col("size")) | (F.abs(along) > LINE_GAP * col("size"))
    gap = ~breaks & (along > WORD_GAP * col("size")) & (col("c") != " ") & (col("p.c") != " ")
    left, up = -col("dy") * col("size"), col("dx") * col("size")
    xs = [a + b for a in (col("x"), col("x") + col("dx") * col("advance")) for b in (left * 0.8, left * -0.2, F.lit(0.0))]
    ys = [a + b for a in (col("y"), col("y") + col("dy") * col("advance")) for b in (up * 0.8, up * -0.2, F.lit(0.0))]
    numbered = seen.withColumns({"line": F.sum(breaks.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "t": F.when(gap, F.concat(F.lit(" "), "c")).otherwise(col("c"))})
    first = lambda c: F.min_by(c, "seq")
    found = numbered.groupBy(key, "page", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda s: s["t"]), "").alias("text"),
        F.max("size").alias("size"),
        F.min(F.least(*xs)).alias("x0"), F.min(F.least(*ys)).alias("y0"), F.max(F.greatest(*xs)).alias("x1"), F.max(F.greatest(*ys)).alias("y1"),
        first("dx").alias("dx"), first("dy").alias("dy"), first("x").alias("first_x"), first("y").alias("first_y"),
    )
    return found.where(F.trim("text") != "")


def blocks(found: DataFrame, key: str) -> DataFrame:
    """Adds ``block`` to lines: a line goes on with a block that it follows closely, the same way, overlapping it."""
    w = Window.partitionBy(key, "page").orderBy("line")
    seen = found.withColumn("p", F.lag(F.struct("size", "x0", "y0", "x1", "y1", "dx", "dy", "first_x", "first_y")).over(w))
    col = F.col
    step = (col("first_x") - col("p.first_x")) * col("p.dy") - (col("first_y") - col("p.first_y")) * col("p.dx")
    flat = F.abs(col("p.dx")) >= F.abs(col("p.dy"))
    overlap = F.when(flat, (col("p.x0") < col("x1")) & (col("x0") < col("p.x1"))).otherwise((col("p.y0") < col("y1")) & (col("y0") < col("p.y1")))
    goes_on = (col("p.dx") * col("dx") + col("p.dy") * col("dy") >= SAME_WAY) & (step > 0) & (step <= LINE_STEP * F.greatest("size", "p.size")) & overlap
    return seen.withColumn("block", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("p")


def page_texts(chars: DataFrame, key: str) -> DataFrame:
    """(key, page, text): a line end after each line, an empty line between blocks."""
    placed = blocks(lines(chars, key), key)
    one = placed.groupBy(key, "page", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return one.groupBy(key, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda s: s["text"]), "\n\n").alias("text"))
