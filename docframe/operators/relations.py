"""Relational operators over what documents yield: links, outlines, ranges, sequences, boxes.

All are DataFrame expressions: a window or a join where a sequential program
would keep state, so Spark plans and distributes them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- matches of a pattern as rows ---------------------------------------------------------------


def matches(df: DataFrame, keys: list[str], text: Column, pattern: str, groups: dict[str, int]) -> DataFrame:
    """One row a match, with its number from 0 and the named groups."""
    arrays = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(name) for name, g in groups.items()))
    return df.select(*keys, F.posexplode(arrays).alias("ord", "_m")).select(*keys, "ord", *(F.col(f"_m.{n}").alias(n) for n in groups))


# -- outlines -----------------------------------------------------------------------------------


def nest(df: DataFrame, part: str, order: str, level: str, deepest: int = 6) -> DataFrame:
    """Adds ``parent``: the order number of the nearest earlier row of a smaller level, null at the top.

    One running last-value a level, all over one sort; the greatest of those of
    smaller levels is the nearest.
    """
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(w).alias(f"_l{k}") for k in range(1, deepest)]
    seen = df.select("*", *last)
    parent = F.greatest(F.lit(None).cast("long"), *(F.when(F.col(level) > k, F.col(f"_l{k}")) for k in range(1, deepest)))
    return seen.withColumn("parent", parent).drop(*(f"_l{k}" for k in range(1, deepest)))


# -- ranges -------------------------------------------------------------------------------------


def range_join(points: DataFrame, value: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """points inner-joined to the ranges [low, high] that hold their value.

    Ranges are cut at multiples of width and joined by cell, so the join is an
    equi-join with a residual condition; choose width near the usual range's.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    cut = ranges.where(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn("_cell", cell(value)).join(cut, "_cell").where(F.col(value).between(F.col(low), F.col(high))).drop("_cell")


def as_of(facts: DataFrame, at: str, marks: DataFrame, mark_at: str, keep: list[str], by: list[str]) -> DataFrame:
    """facts with the kept columns of the last mark at or before them, of the same `by`.

    Both sides are unioned and sorted once by (by, time); no range join. A key
    with very many facts should carry a bucket of time in `by`, with the last
    mark of earlier buckets added to each.
    """
    both = facts.select("*", F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(_struct_of(marks, keep)).alias("_m")).unionByName(
        marks.select(*by, F.col(mark_at).alias("_at"), F.lit(0).alias("_side"), F.struct(*keep).alias("_m")), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_m", F.last("_m", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*facts.columns, *(F.col(f"_m.{c}").alias(c) for c in keep))


def _struct_of(df: DataFrame, cols: list[str]) -> str:
    return "struct<" + ",".join(f"{c}:{dict(df.dtypes)[c]}" for c in cols) + ">"


# -- sequences ----------------------------------------------------------------------------------


def islands(df: DataFrame, part: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of a sequence: breaks(row) starts a new one. breaks may use lag over the same window."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_b", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def merged_intervals(df: DataFrame, part: str, low: str, high: str) -> DataFrame:
    """(part, island, start, stop, n): the closed intervals [low, high] of a part, joined where they meet, numbered in order.

    Of intervals that begin together the order makes no difference, so no row
    carries more than its two ends. Rows are dealt as in paginate and sorted;
    one pass holds the island it is in and nothing else. A missing low end stands first, a missing high end adds nothing.
    """
    rows = df.select(part, F.col(low).cast("bigint").alias("start"), F.col(high).cast("bigint").alias("stop"))
    kind = dict(df.dtypes)[part]

    def run(batches):
        import pyarrow as pa

        now, out = None, []  # part, island, start, stop, n

        def emit(most):
            cols = zip(*out[:most], strict=True)
            b = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, arrow, strict=True)], names=[part, "island", "start", "stop", "n"])
            del out[:most]
            return b

        for b in batches:
            arrow = [b.schema.types[0], *[pa.int64()] * 4]
            for key, s, e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or key != now[0]:
                    now = [key, 1, s, e, 1]
                    out.append(now)
                elif s is not None and now[3] is not None and s <= now[3]:
                    now[4] += 1
                    now[2] = s if now[2] is None else now[2]
                    now[3] = now[3] if e is None or e < now[3] else e
                else:
                    now = [key, now[1] + 1, s, e, 1]
                    out.append(now)
            if len(out) > 1:  # the last may go on in the next batch
                yield emit(len(out) - 1)
        if out:
            yield emit(1)

    dealt = rows.repartition(_enough(df), part).sortWithinPartitions(part, "start", "stop")
    return dealt.mapInArrow(run, f"{part} {kind}, island bigint, start bigint, stop bigint, n bigint")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    one = df.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in df.columns if c not in keys)), F.struct(*order)).alias("_r"))
    return one.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in df.columns if c not in keys))


def paginate(df: DataFrame, part: str, order: str, height: str, page_height: float) -> DataFrame:
    """Adds ``page``: spans in order fill pages greedily; a span is never cut and a page never empty.

    Rows are dealt by part over partitions that adaptive execution keeps and
    sorted; one pass over a partition carries the page from batch to batch, so
    a part of any length needs no memory, and a short one no call of its own.
    """
    return _paged(_spans(df, part, order, height), part, order, height, page_height)


def paginate_numbered(df: DataFrame, part: str, by: list[str], height: str, page_height: float, line: str = "line") -> DataFrame:
    """(part, line, height, page): the same where spans are not numbered yet but ordered by columns; numbers begin at 0."""
    dealt = df.select(part, *by, F.col(height).cast("double").alias(height)).repartition(_enough(df), part).sortWithinPartitions(part, *by)
    return _paged(dealt.select(part, F.lit(None).cast("bigint").alias(line), height), part, line, height, page_height, number=True)


def _spans(df: DataFrame, part: str, order: str, height: str) -> DataFrame:
    rows = df.select(part, F.col(order).cast("bigint").alias(order), F.col(height).cast("double").alias(height))
    return rows.repartition(_enough(df), part).sortWithinPartitions(part, order)


def _enough(df: DataFrame, most: int = 8 << 20) -> int:
    """Partitions to deal over: those of the session, and more where the plan's size asks for it."""
    planned = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(planned, min(size // most, 4096)) if size < 1 << 50 else planned  # beyond that it is not known


def _paged(rows: DataFrame, part: str, order: str, height: str, page_height: float, number: bool = False) -> DataFrame:
    """number: the order's numbers are made here."""
    kind = dict(rows.dtypes)[part]

    def run(batches):
        import pyarrow as pa

        now, line, page, used, begun = None, 0, 0, 0.0, False
        for b in batches:
            pages, lines = [], []
            for key, h in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                h = math.nan if h is None else h  # as a sum with null: no page ends after it
                if not begun or key != now:
                    now, line, page, used, begun = key, 0, 0, 0.0, True
                elif used > 0 and used + h > page_height:
                    page, used = page + 1, 0.0
                used += h
                pages.append(page)
                lines.append(line)
                line += 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lines, pa.int64()) if number else b.column(1), b.column(2), pa.array(pages, pa.int32())], names=[part, order, height, "page"])

    return rows.mapInArrow(run, f"{part} {kind}, {order} bigint, {height} double, page int")


def paginate_rows(df: DataFrame, part: str, heights: str, page_height: float) -> DataFrame:
    """(part, line, h, page) of rows that hold their spans' heights as an array: the same fold as paginate, and no shuffle."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at, line, height, page = [], [], [], []
            for k, hs in enumerate(b.column(1).to_pylist()):
                now, used = 0, 0.0
                for i, h in enumerate(hs or ()):
                    if used > 0 and used + h > page_height:
                        now, used = now + 1, 0.0
                    used += h
                    at.append(k)
                    line.append(i)
                    height.append(h)
                    page.append(now)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(line, pa.int64()), pa.array(height, pa.float64()), pa.array(page, pa.int32())], names=[part, "line", "h", "page"])

    return df.select(part, F.col(heights).cast("array<double>")).mapInArrow(run, f"{part} {dict(df.dtypes)[part]}, line bigint, h double, page int")


# -- boxes --------------------------------------------------------------------------------------


def union_box(x0: str, y0: str, x1: str, y1: str) -> list[Column]:
    return [F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1")]


def transformed(m: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    """(a, b, c, d, e, f) applied to a point."""
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f
