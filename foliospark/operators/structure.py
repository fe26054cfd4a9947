"""Structure of works: hierarchy, classification, furniture, reading order, layout."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as t

LEVELS = range(1, 7)


def toc_depths(entries: DataFrame) -> DataFrame:
    """Adds ``depth`` and ``parent`` (the order number of the nearest earlier entry of a smaller level) to work, ord, level.

    An entry's ancestors are, for each smaller level, its latest earlier entry, unless one of a still smaller level came
    after it. So six running maxima stand for a stack."""
    before = Window.partitionBy("work").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    df = entries
    for k in LEVELS:
        df = df.withColumn(f"last_{k}", F.coalesce(F.max(F.when(F.col("level") == k, F.col("ord"))).over(before), F.lit(-1).cast("long")))
    depth, parent = F.lit(1), F.lit(-1).cast("long")
    for k in LEVELS:
        above = F.greatest(F.lit(-1).cast("long"), *[F.col(f"last_{j}") for j in range(1, k)], F.lit(-1).cast("long"))
        alive = (F.col(f"last_{k}") > above) & (F.col("level") > k)
        depth = depth + alive.cast("int")
        parent = F.greatest(parent, F.when(alive, F.col(f"last_{k}")).otherwise(-1))
    return df.select(*entries.columns, depth.cast("long").alias("depth"), F.when(parent >= 0, parent).alias("parent"))


def toc_tree(entries: DataFrame) -> DataFrame:
    """work and tree: the entries (work, ord, level, label) nested as JSON, ``[{"label": ..., "children": [...]}, ...]``, as a VARIANT.

    Nested from the deepest level upwards, a step a level: the texts of one parent's children are joined in their order
    and become part of the parent's own."""
    nodes = toc_depths(entries.select("work", "ord", "level", "label")).select("work", "ord", "depth", "parent", "label")
    made = nodes.where("1 = 0").select("work", "ord", "depth", "parent", F.lit("").alias("text"))
    for depth in range(len(LEVELS), 0, -1):
        inner = made.groupBy("work", F.col("parent").alias("ord")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), ",").alias("inner"))
        label = F.regexp_extract(F.to_json(F.struct(F.coalesce("label", F.lit("")).alias("label"))), r"(?s)^\{(.*)\}$", 1)
        text = F.concat(F.lit("{"), label, F.lit(',"children":['), F.coalesce("inner", F.lit("")), F.lit("]}"))
        made = nodes.where(F.col("depth") == depth).join(inner, ["work", "ord"], "left").select("work", "ord", "depth", "parent", text.alias("text"))
    tops = made.groupBy("work").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), ",").alias("text"))
    return tops.select("work", F.parse_json(F.concat(F.lit("["), "text", F.lit("]"))).alias("tree"))


#: Words of a title, the region and the kind they stand for; the first hit in this order counts. Fixed values.
TITLE_KINDS = (
    (("封面", "cover"), "cover", "cover"),
    (("半书名页", "简书名页", "half-title", "half title", "half title page"), "frontmatter", "half-title"),
    (("书名页", "标题页", "titlepage", "title page"), "frontmatter", "titlepage"),
    (("版权", "copyright"), "frontmatter", "copyright"),
    (("献词", "题献", "dedication"), "frontmatter", "dedication"),
    (("他序", "序言", "序", "foreword"), "frontmatter", "foreword"),
    (("前言", "自序", "preface", "引言"), "frontmatter", "preface"),
    (("目录", "目次", "toc", "contents", "table of contents"), "frontmatter", "toc"),
    (("后记", "跋", "afterword"), "backmatter", "afterword"),
    (("附录", "appendix", "appendix a"), "backmatter", "appendix"),
    (("注释", "尾注", "notes", "endnotes"), "backmatter", "notes"),
    (("参考文献", "参考书目", "bibliography", "references", "sources and literature", "sources & literature"), "backmatter", "bibliography"),
    (("索引", "index"), "backmatter", "index"),
    (("术语表", "glossary"), "backmatter", "glossary"),
)


def title_pattern(words: tuple[str, ...]) -> str:
    """ASCII words stand alone, others anywhere."""
    return "|".join(rf"(?:^|[^a-z0-9]){w}(?:$|[^a-z0-9])" if w.isascii() else w for w in words)


def title_kind(title: Column) -> tuple[Column, Column]:
    region, kind = F.lit("body"), F.lit("chapter")
    for words, r, k in reversed(TITLE_KINDS):
        hit = F.lower(title).rlike(title_pattern(words))
        region, kind = F.when(hit, r).otherwise(region), F.when(hit, k).otherwise(kind)
    return region, kind


def classified(units: DataFrame) -> DataFrame:
    """work, ord, title with region, kind and unit_id: covers and matter are numbered by kind from the second on, chapters through the work."""
    region, kind = title_kind(t.text_of("title"))
    df = units.withColumn("region", region).withColumn("kind", kind)
    n = F.row_number().over(Window.partitionBy("work", "region", "kind").orderBy("ord"))
    df = df.withColumn("n", n)
    suffix = F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit("-"), F.col("n").cast("string")))
    name = F.when(F.col("region") == "cover", F.concat(F.lit("cover"), suffix)).when(F.col("region") == "frontmatter", F.concat(F.lit("front-"), F.col("kind"), suffix)).when(F.col("region") == "backmatter", F.concat(F.lit("back-"), F.col("kind"), suffix))
    chapter = F.concat(F.lit("ch"), F.when(F.col("n") < 100, F.lpad(F.col("n").cast("string"), 2, "0")).otherwise(F.col("n").cast("string")))
    return df.select("work", "ord", "title", "region", "kind", F.coalesce(name, chapter).alias("unit_id"))


def repeated_furniture(lines: DataFrame, *, min_pages=3, longest=40) -> DataFrame:
    """work, page, line, text, role: short first and last lines that recur on half of a work's pages, two at least.

    A page's only short line counts in both tallies and is called a header."""
    pages = lines.groupBy("work").agg(F.countDistinct("page").alias("pages"))
    short = lines.where(F.char_length("text") <= longest)
    w = Window.partitionBy("work", "page")
    edge = short.withColumn("first", F.min("line").over(w)).withColumn("last", F.max("line").over(w)).where("line = first or line = last")
    tallies = edge.groupBy("work", "text").agg(F.count_if(F.col("line") == F.col("first")).alias("heads"), F.count_if(F.col("line") == F.col("last")).alias("feet"))
    often = tallies.join(pages, "work").where(F.col("pages") >= min_pages).where(F.greatest("heads", "feet") >= F.greatest(F.lit(2), F.floor(F.col("pages") / 2))).select("work", "text")
    found = edge.join(often, ["work", "text"], "left_semi")
    return found.select("work", "page", "line", "text", F.when(F.col("line") == F.col("first"), "repeated_header").otherwise("repeated_footer").alias("role"))


def page_breaks(lines: DataFrame) -> DataFrame:
    """work, page, next_page, tail, head: pages whose last line ends in no terminal mark, with the next page's first line."""
    w = Window.partitionBy("work", "page")
    edges = lines.withColumn("first", F.min("line").over(w)).withColumn("last", F.max("line").over(w))
    by_page = edges.groupBy("work", "page").agg(F.max(F.when(F.col("line") == F.col("first"), F.col("text"))).alias("head"), F.max(F.when(F.col("line") == F.col("last"), F.col("text"))).alias("tail"))
    order = Window.partitionBy("work").orderBy("page")
    pairs = by_page.select("work", "page", F.lead("page").over(order).alias("next_page"), "tail", F.lead("head").over(order).alias("head"))
    return pairs.where(F.col("next_page").isNotNull() & ~F.right("tail", F.lit(1)).isin(*(t.TERMINAL + t.CLOSERS + ";；:：")))


def fifo_matched(left: DataFrame, right: DataFrame, key: str, *, by: list[str], order: str) -> DataFrame:
    """Rows of either side paired by occurrence: the n-th of a key on the left with the n-th on the right; a side is null where the other has more."""
    def numbered(df, side):
        n = F.row_number().over(Window.partitionBy(*by, key).orderBy(order))
        return df.withColumn("n", n).select(*by, key, "n", F.col(order).alias(f"{side}_{order}"))

    return numbered(left, "left").join(numbered(right, "right"), [*by, key, "n"], "full_outer")


PAGE = ("work", "page")


def bands(boxes: DataFrame) -> DataFrame:
    """Adds ``band`` to work, page, x0, x1: intervals that overlap, directly or through others, are one band, from left to right."""
    before = Window.partitionBy(*PAGE).orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*PAGE).orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("x0") <= F.max("x1").over(before), 0).otherwise(1)
    return boxes.withColumn("new", new).withColumn("band", (F.sum("new").over(order) - 1).cast("long")).drop("new")


def reading_order(boxes: DataFrame, wide=0.6) -> DataFrame:
    """work, page, block, place: wide blocks above all columns, then zone by zone (cut by the wide blocks in between) column by column, then wide blocks below.

    Takes work, page, block, x0, y0, x1, y1. A page with a block without a box keeps its order."""
    p = Window.partitionBy(*PAGE)
    df = boxes.withColumn("whole", F.bool_and(F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()).over(p))
    df = df.withColumn("wide", F.coalesce(F.col("x1") - F.col("x0") >= wide * F.max("x1").over(p), F.lit(False)))
    narrow = bands(df.where("not wide and whole").select(*PAGE, "block", "x0", "x1")).select(*PAGE, "block", "band")
    df = df.join(narrow, [*PAGE, "block"], "left")
    top, bottom = F.min(F.when(~F.col("wide"), F.col("y0"))).over(p), F.max(F.when(~F.col("wide"), F.col("y1"))).over(p)
    df = df.withColumn("part", F.when(~F.col("wide"), 1).when(top.isNull() | (F.col("y1") <= top), 0).when(F.col("y0") >= bottom, 2).otherwise(1))
    df = df.withColumn("cut", F.col("wide") & (F.col("part") == 1))
    upto = Window.partitionBy(*PAGE).orderBy("y0").rangeBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("zone", F.when(F.col("part") == 1, F.sum(F.col("cut").cast("int")).over(upto)).otherwise(0))
    # a wide block in between opens its zone
    order = Window.partitionBy(*PAGE).orderBy(F.when(~F.col("whole"), F.col("block")), "part", "zone", F.when(F.col("cut"), -1).otherwise(F.coalesce("band", F.lit(0))), "y0", "x0", "block")
    return df.select(*PAGE, "block", F.row_number().over(order).cast("long").alias("place"))


def columns_by_anchor(boxes: DataFrame, tolerance=0.08) -> DataFrame:
    """work, page, block, column: centres from left to right; a centre further than the tolerance from its column's first one opens the next.

    The anchor is the column's first centre and not the row before, so a page's sorted centres are read with one number carried along."""

    def fold(rows: pa.Table) -> pa.Table:
        centers = [(a + b) / 2 for a, b in zip(rows["x0"].to_pylist(), rows["x1"].to_pylist())]
        reach = max(1.0, max(rows["x1"].to_pylist()) * tolerance)
        blocks = rows["block"].to_pylist()
        anchor, column, found = None, -1, [0] * len(centers)
        for i in sorted(range(len(centers)), key=lambda i: (centers[i], blocks[i])):
            if anchor is None or centers[i] - anchor > reach:
                anchor, column = centers[i], column + 1
            found[i] = column
        return rows.select(["work", "page", "block"]).append_column("column", pa.array(found, pa.int64()))

    kinds = boxes.select("work", "page", "block").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.fields) + ", column long"
    return boxes.select("work", "page", "block", F.col("x0").cast("double"), F.col("x1").cast("double")).groupBy(*PAGE).applyInArrow(fold, schema)


def page_chain(numbers: DataFrame, *, reach=3, least=5) -> DataFrame:
    """work, page, value: the longest run of page-edge numbers that follow the pages (0 to ``reach`` ahead of them) and rise by 1 to ``reach`` from one to the next; none under ``least`` pages.

    How a run goes on depends only on the number it has reached, so one pass from the last page back gives the length of the
    run from every number; the first of the longest that start with a page's smallest number is taken."""
    def fold(rows: pa.Table) -> pa.Table:
        by_page: dict[int, list[int]] = {}
        for page, value in sorted(zip(rows["page"].to_pylist(), rows["value"].to_pylist())):
            by_page.setdefault(page, []).append(value)
        pages = list(by_page.items())
        length: list[dict[int, int]] = [{} for _ in pages]

        def following(i: int, value: int) -> int | None:
            return next((v for v in pages[i + 1][1] if value < v <= value + reach), None) if i + 1 < len(pages) else None

        for i in range(len(pages) - 1, -1, -1):
            for value in pages[i][1]:
                after = following(i, value)
                length[i][value] = 1 + (length[i + 1][after] if after is not None else 0)
        best: list[tuple[int, int]] = []
        if pages:
            i = max(range(len(pages)), key=lambda i: length[i][pages[i][1][0]])
            value: int | None = pages[i][1][0]
            while value is not None:
                best.append((pages[i][0], value))
                value = following(i, value)
                i += 1
        best = best if len(best) >= least else []
        work = rows["work"][0].as_py()
        return pa.table({"work": pa.array([work] * len(best), pa.string()), "page": pa.array([p for p, _ in best], pa.int64()), "value": pa.array([v for _, v in best], pa.int64())})

    near = numbers.where(f"value - page between 0 and {reach}").distinct()
    return near.groupBy("work").applyInArrow(fold, "work string, page long, value long")


def ranged(starts: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with the bookmark whose range [start, next start) holds them: a running maximum over the union, not a range join."""
    both = starts.select("work", F.col("page"), F.lit(0).alias("kind"), "title").union(pages.select("work", "page", F.lit(1), F.lit(None).cast("string")))
    upto = Window.partitionBy("work").orderBy("page", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("chapter", F.last("title", ignorenulls=True).over(upto)).where("kind = 1").select("work", "page", "chapter")


def rising_bookmarks(bookmarks: DataFrame) -> DataFrame:
    """Level-1 bookmarks whose page exceeds all before; none where fewer than two are left."""
    first = bookmarks.where("level = 1")
    before = Window.partitionBy("work").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    kept = first.withColumn("seen", F.coalesce(F.max("page").over(before), F.lit(-1))).where("page > seen").drop("seen")
    return kept.withColumn("n", F.count("*").over(Window.partitionBy("work"))).where("n >= 2").drop("n")


def packed_blocks(blocks: DataFrame, budget: int) -> DataFrame:
    """unit, block, chunk: blocks in order, a new chunk when the next would exceed the budget; an oversize block stands alone.

    Only a unit's lengths are read, in order, with two numbers carried along."""

    def fold(rows: pa.Table) -> pa.Table:
        blocks, sizes = rows["block"].to_pylist(), rows["n"].to_pylist()
        found, chunk, used = [0] * len(blocks), 1, 0
        for i in sorted(range(len(blocks)), key=blocks.__getitem__):
            if used and used + sizes[i] > budget:
                chunk, used = chunk + 1, 0
            used += sizes[i]
            found[i] = chunk
        return rows.select(["unit", "block"]).append_column("chunk", pa.array(found, pa.int64()))

    sizes = blocks.select("unit", "block", F.char_length("text").cast("long").alias("n"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sizes.schema.fields[:2]) + ", chunk long"
    return sizes.groupBy("unit").applyInArrow(fold, schema)


def numbered_runs(paragraphs: DataFrame) -> DataFrame:
    """unit, ord, n: paragraph numbers of runs that count 1, 2, ... without a gap, two at least."""
    order = Window.partitionBy("unit").orderBy("ord")
    runs = paragraphs.withColumn("run", F.sum(F.when(F.col("n") == F.coalesce(F.lag("n").over(order), F.lit(-1)) + 1, 0).otherwise(1)).over(order))
    w = Window.partitionBy("unit", "run")
    return runs.withColumn("first", F.min("n").over(w)).withColumn("size", F.count("*").over(w)).where("first = 1 and size >= 2").select("unit", "ord", "n")
