"""Layout: lines to regions, boundaries between lines, blocks, reading order, tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators.pages import by_page
from quire.sources.derived import VISUAL

#: Height of the bands that lines and regions meet in, so that a long page is no product of its lines and regions.
BAND = 512
#: What stands between two lines.
SEPARATORS = {
    "CONTINUE_WITH_SPACE": " ",
    "CONTINUE_WITHOUT_SPACE": "",
    "SOFT_LINE_BREAK": "\n",
    "NEW_PARAGRAPH": "\n\n",
    "BLANK_PARAGRAPH_SPACE": "\n\n",
    "LIST_ITEM_BOUNDARY": "\n",
    "TABLE_CELL_BOUNDARY": "\t",
    "PAGE_BREAK": "\f",
    "SECTION_BREAK": "\n\n",
}


def assign(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Each line with `ord` of the smallest region that holds its centre (the first of equals), or null.

    An equi-join on page and band with the box test as residual; the least is a partial aggregate, not a sort.
    """
    r = regions.select("doc_id", "ord", *[F.col(c).alias(f"r_{c}") for c in ("x", "y", "width", "height")])
    r = r.withColumn("band", F.explode(F.sequence(F.floor(F.col("r_y") / BAND), F.floor((F.col("r_y") + F.col("r_height")) / BAND))))
    held = lines.withColumn("band", F.floor((F.col("y") + F.col("height") / 2) / BAND)).join(r, ["doc_id", "band"]).where(G.contains_centre("r_", ""))
    best = held.groupBy("doc_id", "ln").agg(F.min(F.struct((F.col("r_width") * F.col("r_height")).alias("area"), "ord"))["ord"].alias("ord"))
    return lines.join(best, ["doc_id", "ln"], "left")


def unassigned(lines: DataFrame, regions: DataFrame) -> DataFrame:
    return assign(lines, regions).where("ord is null").drop("ord")


def decided(kind: Column, before: Column, after: Column, gap: Column, shift: Column) -> Column:
    """What lies between two lines of a block: struct<boundary, confidence>. gap in line heights, shift of the right edge in widths."""
    out = lambda b, c: F.struct(F.lit(b).alias("boundary"), (c if isinstance(c, Column) else F.lit(c)).alias("confidence"))
    return (
        F.when(kind == "TABLE", out("TABLE_CELL_BOUNDARY", 0.98))
        .when(after.rlike(T.LIST_MARKER), out("LIST_ITEM_BOUNDARY", 0.96))
        .when(gap >= 1.8, out("BLANK_PARAGRAPH_SPACE", F.least(F.lit(0.98), 0.75 + gap / 10)))
        .when((gap >= 0.9) & ((shift >= 0.08) | before.rlike(T.TERMINAL)), out("NEW_PARAGRAPH", 0.88))
        .when((before.endswith("-") | before.endswith("ـ")) & (gap < 0.55), out("CONTINUE_WITHOUT_SPACE", 0.8))
        .when(kind.isin("CAPTION", "QUESTION", "ANSWER_OPTION") & (gap > 0.65), out("SOFT_LINE_BREAK", 0.78))
        .otherwise(out("CONTINUE_WITH_SPACE", 0.76))
    )


def boundaries(members: DataFrame) -> DataFrame:
    """Lines of blocks (doc_id, ord, block_type, ln, text, box) with boundary, boundary_confidence and before_ln; null at a block's first."""
    w = Window.partitionBy("doc_id", "ord").orderBy("y", F.desc("x"), "ln")
    before = F.lag(F.struct("text", "x", "y", "width", "height", "ln")).over(w)
    seen = members.withColumn("b", before)
    height = F.greatest(F.col("b.height"), F.col("height"), F.lit(1.0))
    gap = F.greatest(F.lit(0.0), F.col("y") - (F.col("b.y") + F.col("b.height"))) / height
    shift = F.abs(F.col("b.x") + F.col("b.width") - G.right()) / F.greatest(F.col("b.width"), F.lit(1.0))
    d = F.when(F.col("b").isNotNull(), decided(F.col("block_type"), F.col("b.text"), F.col("text"), gap, shift))
    return seen.withColumn("d", d).select(*members.columns, F.col("b.ln").alias("before_ln"), F.col("d.boundary").alias("boundary"), F.col("d.confidence").alias("boundary_confidence"))


def members(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Every line with its block: its region, or one of its own."""
    types = regions.select("doc_id", "ord", F.col("block_type").alias("rt"))
    return assign(lines, regions).join(types, ["doc_id", "ord"], "left").select("doc_id", F.coalesce("ord", 1000000 + F.col("ln")).alias("ord"), F.coalesce("rt", F.lit("UNKNOWN")).alias("block_type"), "ln", "text", "x", "y", "width", "height", "conf100")


def blocks(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks with literal text, confidence, refined type, unresolved flag and (simple) reading order."""
    separator = F.coalesce(F.create_map(*[F.lit(x) for kv in SEPARATORS.items() for x in kv])[F.col("boundary")], F.lit(""))
    found = boundaries(members(lines, regions))
    parts = F.array_sort(F.collect_list(F.struct("y", (-F.col("x")).alias("nx"), "ln", F.concat(separator, "text").alias("part"))))
    grouped = found.groupBy("doc_id", "ord").agg(
        F.count("*").alias("n_lines"),
        F.round(F.sum("conf100") / F.count("*") / 100.0, 6).alias("conf"),
        F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("literal"),
        F.coalesce(F.bool_or(F.col("boundary_confidence") < 0.8), F.lit(False)).alias("unsure"),
        *[F.min(c).alias(f"l_{c}") for c in ("x", "y", "width", "height")],
    )
    held = regions.join(grouped.drop("l_x", "l_y", "l_width", "l_height"), ["doc_id", "ord"], "left").where(F.col("n_lines").isNotNull() | F.col("block_type").isin(VISUAL))
    held = held.select("doc_id", "ord", F.col("block_type").alias("region_type"), "x", "y", "width", "height", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("conf", F.round(F.col("conf100") / 100.0, 6)).alias("confidence"), F.coalesce("literal", F.lit("")).alias("literal"), F.coalesce("unsure", F.lit(False)).alias("unsure"))
    alone = grouped.where("ord >= 1000000").select("doc_id", "ord", F.lit("UNKNOWN").alias("region_type"), *[F.col(f"l_{c}").alias(c) for c in ("x", "y", "width", "height")], "n_lines", F.col("conf").alias("confidence"), "literal", "unsure")
    typed = held.unionByName(alone).withColumn("block_type", T.refined_type(F.col("region_type"), F.col("literal"), F.col("confidence"), F.col("n_lines")))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("y", F.desc("x"), "ord")).cast("long") - 1
    return typed.withColumn("unresolved", (F.col("confidence") < 0.7) | (F.col("block_type") == "UNKNOWN")).withColumn("reading_order", order)


def hypothesis(found: DataFrame) -> DataFrame:
    """A second provider's view of blocks: some missing, shifted, emptied, misread or of another type, and some that only it has, off the page."""
    s = F.col("doc_id") + F.col("ord")
    text = F.col("literal")
    read = F.when(s % 23 == 0, "").when(s % 29 == 0, F.regexp_replace(text, "[a-z]", "#")).when(s % 7 == 0, F.replace(text, F.lit("e"), F.lit("c"))).otherwise(text)
    moved = found.where((s % 11) != 0).select(
        "doc_id",
        "ord",
        F.when(s % 13 == 0, "BODY_PARAGRAPH").otherwise(F.col("block_type")).alias("block_type"),
        (F.col("x") + F.col("ord") % 5).alias("x"),
        (F.col("y") + F.col("ord") % 5).alias("y"),
        "width",
        "height",
        "confidence",
        read.alias("literal"),
        "unresolved",
    )
    own = found.where((s % 17) == 0).select("doc_id", (F.col("ord") + 2000000).alias("ord"), F.lit("BODY_PARAGRAPH").alias("block_type"), (F.col("x") + 2000).alias("x"), "y", "width", "height", "confidence", F.lit("only here").alias("literal"), F.lit(False).alias("unresolved"))
    return moved.unionByName(own).withColumn("reading_order", F.row_number().over(Window.partitionBy("doc_id").orderBy("y", F.desc("x"), "ord")).cast("long") - 1)


def parallel(found: DataFrame) -> DataFrame:
    """Pages on which two blocks stand side by side. Pairs meet by bands, not all with all."""
    def side(p: str) -> DataFrame:
        b = found.select("doc_id", *[F.col(c).alias(f"{p}{c}") for c in ("ord", "x", "y", "width", "height")])
        return b.withColumn("band", F.explode(F.sequence(F.floor(F.col(f"{p}y") / BAND), F.floor(G.bottom(p) / BAND))))

    pairs = side("a_").join(side("b_"), ["doc_id", "band"]).where("a_ord < b_ord and least(a_height, b_height) > 0")
    beside = (G.overlap_y("a_", "b_") >= 0.25 * F.least("a_height", "b_height")) & (G.overlap_x("a_", "b_") <= 0.15 * F.least("a_width", "b_width"))
    return pairs.where(beside).select("doc_id").distinct()


# The rest is sequential within a page: each step depends on running means of the steps before. It runs once per page, on that
# page's few columns of numbers.


def _side_by_side(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> bool:
    order = np.argsort(y, kind="stable")
    x, y, w, h = (v[order].tolist() for v in (x, y, w, h))
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            if y[j] >= y[i] + h[i] and h[i] > 0:
                break  # all that follow begin below
            least = min(h[i], h[j])
            if least > 0 and min(y[i] + h[i], y[j] + h[j]) - max(y[i], y[j]) >= 0.25 * least and max(0.0, min(x[i] + w[i], x[j] + w[j]) - max(x[i], x[j])) <= 0.15 * min(w[i], w[j]):
                return True
    return False


def columns_of(rows: np.ndarray, boxes: np.ndarray, page_width: float) -> list[int]:
    """A band's rows in order, columns from right to left. They come from the top, of equals the rightmost first; boxes: x, y, width, height."""
    if len(rows) < 2 or not _side_by_side(*boxes[:, rows]):
        return rows.tolist()
    centre = boxes[0] + boxes[2] / 2
    reach = max(page_width * 0.12, float(np.median(boxes[2, rows])) * 0.35)
    groups: list[list[int]] = []  # places among the rows
    sums: list[float] = []
    for k in np.argsort(-centre[rows], kind="stable").tolist():
        c = float(centre[rows[k]])
        for g, total in enumerate(sums):
            if abs(c - total / len(groups[g])) <= reach:
                groups[g].append(k)
                sums[g] += c
                break
        else:
            groups.append([k])
            sums.append(c)
    ranked = sorted(range(len(groups)), key=lambda g: -sums[g] / len(groups[g]))
    return [int(rows[k]) for g in ranked for k in sorted(groups[g])]


def page_order(boxes: np.ndarray, page_width: float) -> list[int]:
    """Places of a page's blocks in reading order; wide blocks part the page into bands. A separator of no height may come twice."""
    x, y, w, h = boxes
    rows = np.lexsort((-x, y))
    wide = rows[w[rows] >= 0.68 * page_width]
    if len(rows) <= 1 or not len(wide):
        return columns_of(rows, boxes, page_width)
    out: list[int] = []
    begin = 0.0
    for at in wide.tolist():
        band = rows[(rows != at) & (y[rows] >= begin) & (y[rows] < y[at])]
        out += [*columns_of(band, boxes, page_width), at]
        begin = float(y[at] + h[at])
    left = rows[~np.isin(rows, out)]
    out += columns_of(left[(w[left] < 0.68 * page_width) & (y[left] >= begin)], boxes, page_width)
    done = set(out)
    return out + [i for i in rows.tolist() if i not in done]


def reading_order(found: DataFrame, page_width: float) -> DataFrame:
    """doc_id, ord, position of every block, by columns and bands."""

    def work(page: dict[str, np.ndarray]) -> list[tuple]:
        order = page_order(np.stack([page[c] for c in ("x", "y", "width", "height")]), page_width)
        ords = page["ord"].tolist()
        return [(int(page["doc_id"][0]), ords[i], k) for k, i in enumerate(order)]

    return by_page(found.where("doc_id is not null").select("doc_id", "ord", "x", "y", "width", "height"), ["doc_id"], ["ord"], work, "doc_id long, ord long, position long")


def clustered(values: list[float], reach: float) -> list[list[int]]:
    """Groups of places in ascending value; one ends where the next value is further than reach from the group's mean."""
    groups: list[list[int]] = []
    total = 0.0
    for i in sorted(range(len(values)), key=lambda i: values[i]):
        if groups and values[i] - total / len(groups[-1]) <= reach:
            groups[-1].append(i)
            total += values[i]
        else:
            groups.append([i])
            total = values[i]
    return groups


def inferred_table(lines: list[dict], width: float) -> dict | None:
    """Rows, columns and cells of a grid that lines of a region form; None for less than two by two."""
    lines = [x for x in lines if x["text"].strip()]
    if len(lines) < 4:
        return None
    cx = [x["x"] + x["width"] / 2 for x in lines]
    cy = [x["y"] + x["height"] / 2 for x in lines]
    high = float(np.median([x["height"] for x in lines]))
    centres = sorted((float(np.mean([cx[i] for i in g])) for g in clustered(cx, max(0.14 * width, 40.0))), reverse=True)
    first = clustered(cy, max(0.8 * high, 18.0))
    at = [float(np.mean([cy[i] for i in g])) for g in first]
    rows: list[list[int]] = []
    last = 0.0
    typical = float(np.median(np.diff(at))) if len(at) > 1 else 2 * high
    for g, c in zip(first, at, strict=True):
        if rows and len(first) > 1 and len(g) == 1 and len(rows[-1]) >= 2 and c - last < max(0.72 * typical, 1.7 * high):
            rows[-1] = rows[-1] + g
        else:
            rows.append(g)
            last = c
    if len(centres) < 2 or len(rows) < 2:
        return None
    cells: dict[tuple[int, int], list[int]] = {}
    for r, g in enumerate(rows):
        for i in g:
            cells.setdefault((r, min(range(len(centres)), key=lambda k: abs(cx[i] - centres[k]))), []).append(i)
    text = lambda own: "\n".join(lines[i]["text"] for i in sorted(own, key=lambda i: (lines[i]["y"], -lines[i]["x"], i)))
    return {"rows": len(rows), "columns": len(centres), "cells": [{"row": r, "column": c, "text": text(own)} for (r, c), own in sorted(cells.items())]}


def tables(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, ord, rows, columns, row, column, text of the cells of every region of type TABLE that holds a grid."""
    held = lines.join(regions.where("block_type = 'TABLE'").select("doc_id", "ord", F.col("width").alias("region_width")), ["doc_id", "ord"])

    def work(group: dict[str, np.ndarray]) -> list[tuple]:
        columns = ("text", "x", "y", "width", "height")
        table = inferred_table([dict(zip(columns, row, strict=True)) for row in zip(*(group[c].tolist() for c in columns), strict=True)], float(group["region_width"][0]))
        return [(int(group["doc_id"][0]), int(group["ord"][0]), table["rows"], table["columns"], c["row"], c["column"], c["text"]) for c in (table["cells"] if table else [])]

    kept = held.where("doc_id is not null").select("doc_id", "ord", "ln", "text", "x", "y", "width", "height", "region_width")
    return by_page(kept, ["doc_id", "ord"], ["ln"], work, "doc_id long, ord long, rows long, columns long, row long, column long, text string")


def table_literal(cells: DataFrame) -> DataFrame:
    """Tab-separated text of each table: the first cell of a place, nothing where there is none."""
    grouped = cells.groupBy("doc_id", "ord").agg(F.max("rows").alias("rows"), F.max("columns").alias("columns"), F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "row", "column"), "text"))).alias("m"))
    row = lambda r: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1), lambda c: F.coalesce(F.try_element_at("m", F.concat_ws(":", r, c)), F.lit(""))), "\t")
    return grouped.select("doc_id", "ord", F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1), row), "\n").alias("literal"))
