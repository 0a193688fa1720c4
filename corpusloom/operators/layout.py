"""Page layout: columns by gutters, reading order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: points of a text row, least gutter, least share of characters and of common height of a column
ROW, GUTTER, SHARE, OVERLAP = 5.0, 15.0, 0.15, 0.30


def gutters(blocks: DataFrame, by: list[str]) -> DataFrame:
    """by, x (middle), width: the horizontal gaps of GUTTER points or more between block spans; one window, no Python."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*by).orderBy("x0", "x1").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max("x1").over(w)
    return blocks.withColumn("_r", reach).filter(F.col("x0") - F.col("_r") >= GUTTER).select(*by, ((F.col("x0") + F.col("_r")) / 2).alias("x"), (F.col("x0") - F.col("_r")).alias("width"))


def _assign(page: pd.DataFrame) -> np.ndarray:
    """Column number of each block, left to right. Work list of block sets; each is cut at its widest gap whose sides look like columns."""
    x0, x1, y0, y1 = (page[c].to_numpy(float) for c in ("x0", "x1", "y0", "y1"))
    size = page.text.fillna("").str.len().to_numpy(float)
    todo, done = [np.argsort(x0, kind="stable")], []
    while todo:
        rows = todo.pop()
        cut = None
        if len(rows) >= 4:
            rows = rows[np.lexsort((x1[rows], x0[rows]))]
            reach = np.maximum.accumulate(x1[rows])
            gap = x0[rows][1:] - reach[:-1]
            chars = np.cumsum(size[rows])
            for i in np.argsort(-gap, kind="stable"):
                if gap[i] < GUTTER:
                    break
                a, b = rows[: i + 1], rows[i + 1 :]  # sorted by x0, a gap leaves whole blocks on both sides
                share = chars[i] / chars[-1] if chars[-1] else 0.0
                common = min(y1[a].max(), y1[b].max()) - max(y0[a].min(), y0[b].min())
                height = max(y1[a].max(), y1[b].max()) - min(y0[a].min(), y0[b].min())
                if min(share, 1 - share) >= SHARE and height > 0 and common / height >= OVERLAP:
                    cut = (a, b)
                    break
        if cut is None:
            done.append(rows)
        else:
            todo += [cut[1], cut[0]]
    out = np.zeros(len(page), np.int64)
    for i, rows in enumerate(done):
        out[rows] = i
    return out


def columns(blocks: DataFrame, id_col: str) -> DataFrame:
    """blocks (id, page, x0, y0, x1, y1, text) with column (from 0, left to right). A page is one group."""
    kept = blocks.select(id_col, "page", "x0", "y0", "x1", "y1", "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", column long"
    return kept.groupBy(id_col, "page").applyInPandas(lambda p: p.assign(column=_assign(p)), schema)


def columns_per_page(assigned: DataFrame, id_col: str) -> DataFrame:
    """id, columns_per_page: array in page order."""
    per = assigned.groupBy(id_col, "page").agg((F.max("column") + 1).cast("int").alias("n"))
    return per.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "n"))), lambda x: x["n"]).alias("columns_per_page"))


def reading_text(assigned: DataFrame, id_col: str) -> DataFrame:
    """id, text: page by page, column by column, in rows of ROW points from left to right."""
    band = F.bround(F.col("y0") / ROW, 0)
    rows = assigned.groupBy(id_col, "page", "column", band.alias("band")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("line"))
    return rows.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "column", "band", "line"))), lambda x: x["line"]), "\n").alias("text"))
