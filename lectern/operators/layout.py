"""Pages and sheets: what kind a page is, headings by size, repeated boxes, titles over columns."""

from pyspark.sql import Column, DataFrame, Window, functions as F


def page_kind(chars: Column, image_area: Column, drawings: Column) -> Column:
    """text from 40 characters on; scan if images cover half the page; any text is text; scan from 50 drawings on; else blank."""
    return F.when(chars >= 40, "text").when(image_area >= 0.5, "scan").when(chars > 0, "text").when(drawings >= 50, "scan").otherwise("blank")


def is_backdrop(image_share: Column, chars: Column) -> Column:
    return (image_share >= 0.95) & (chars >= 400)


def overlap_share(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Share of the first rectangle that the second covers."""
    w = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0))
    h = F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    area = (ax1 - ax0) * (ay1 - ay0)
    return F.when(area > 0, w * h / area).otherwise(0.0)


def size_histogram(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, size, chars): characters for each font size, rounded to a tenth."""
    return spans.groupBy(*keys, F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("chars"))


def heading_sizes(histogram: DataFrame, keys: list[str], ratio: float = 1.15, share: float = 0.20, levels: int = 3) -> DataFrame:
    """(keys, level, size): the largest sizes above ratio * body (the size with most characters, the smaller of equals) that are no
    more than `share` of all characters."""
    whole = histogram.groupBy(*keys).agg(F.sum("chars").alias("all"), F.max(F.struct("chars", (-F.col("size")).alias("s"))).alias("b"))
    x = histogram.join(whole, keys).where((F.col("size") > -F.col("b.s") * ratio) & (F.col("chars") <= F.col("all") * share))
    level = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("size")))
    return x.withColumn("level", level).where(F.col("level") <= levels).select(*keys, "level", "size")


def template_boxes(boxes: DataFrame, keys: list[str], pages: int = 3, area: float = 0.25) -> DataFrame:
    """(keys, box, pages): rounded boxes that come on `pages` pages or more and cover no more than `area` of one."""
    r = [F.round(F.col(f"box.{c}")).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]
    x = boxes.where(F.col("share") <= area).select(*keys, "page", F.struct(*r).alias("box"))
    return x.groupBy(*keys, "box").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= pages)


def outside_tables(blocks: DataFrame, tables: DataFrame, most: float = 0.5, cell: float = 50.0) -> DataFrame:
    """Text blocks (page, at, x0, y0, x1, y1, ...) of which no table (page, x0, y0, x1, y1) of their page covers more than `most`.

    Blocks meet tables in cells of a grid. A table that covers more than half of a block covers its middle, so that the
    block is in the cell of its middle only and meets few tables; with `most` under a half it is in all its cells.
    """
    number = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    cells = lambda df: df.withColumn("_gx", F.explode(number("x0", "x1"))).withColumn("_gy", F.explode(number("y0", "y1")))
    box = ["x0", "y0", "x1", "y1"]
    # equal boxes of a page, as pages of one form have, meet once
    t = cells(tables.select("page", *box).distinct()).select("page", "_gx", "_gy", *[F.col(c).alias(f"t{c}") for c in box])
    different = blocks.select("page", *box).distinct()
    middle = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / cell)
    placed = different.withColumns({"_gx": middle("x0", "x1"), "_gy": middle("y0", "y1")}) if most >= 0.5 else cells(different)
    share = overlap_share(*[F.col(c) for c in box], *[F.col(f"t{c}") for c in box])
    covered = placed.join(t, ["page", "_gx", "_gy"]).where(share > most).select("page", *box).distinct()
    return blocks.join(covered, ["page", *box], "left_anti")


def reading_order(blocks: DataFrame, keys: list[str], ties: tuple[str, ...] = ()) -> DataFrame:
    """blocks with `place` by top, then left edge, rounded to a tenth; equal ones go by the columns `ties`."""
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("y0", 1), F.round("x0", 1), *ties)) - 1)


def titled_cells(cells: DataFrame, titles: DataFrame) -> DataFrame:
    """cells (sheet, row, col, value) with the `title` of the nearest title (sheet, row, lo, hi, title) above that spans their column.

    Titles come down their columns until the next one; a cell above all titles has none.
    """
    t = titles.select("sheet", F.col("row").cast("int").alias("row"), F.explode(F.sequence("lo", "hi")).alias("col"), "title")
    both = cells.select("sheet", "row", "col", "value", F.lit(None).cast("string").alias("t")).unionByName(t.select("sheet", "row", "col", F.lit(None).cast(dict(cells.dtypes)["value"]).alias("value"), F.col("title").alias("t")))
    w = Window.partitionBy("sheet", "col").orderBy("row", F.col("t").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("title", F.last("t", ignorenulls=True).over(w)).where("t is null").drop("t")


def side_by_side(titled: DataFrame, titles: DataFrame, least_filled: float = 0.5, most_orphans: float = 0.2) -> DataFrame:
    """(sheet, titles, filled, orphans, accepted): whether enough titles have rows of their own and few cells have no title."""
    own = titled.where("title is not null").select("sheet", "title").distinct().groupBy("sheet").agg(F.count("*").alias("filled"))
    lone = titled.groupBy("sheet").agg(F.avg(F.col("title").isNull().cast("double")).alias("orphans"))
    x = titles.groupBy("sheet").agg(F.countDistinct("title").alias("titles")).join(own, "sheet", "left").join(lone, "sheet", "left")
    x = x.select("sheet", "titles", F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce("orphans", F.lit(0.0)).alias("orphans"))
    return x.withColumn("accepted", (F.col("filled") >= F.col("titles") * least_filled) & (F.col("orphans") <= most_orphans))


def shares(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """values with `share`: percent of the sum within keys, to a tenth."""
    total = values.groupBy(*keys).agg(F.sum(value).alias("_t")) if keys else values.agg(F.sum(value).alias("_t"))
    x = values.join(total, keys) if keys else values.join(F.broadcast(total), F.lit(True))  # one row
    return x.withColumn("share", F.round(F.try_divide(F.col(value) * 100, F.col("_t")), 1)).drop("_t")
