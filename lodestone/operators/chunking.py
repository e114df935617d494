"""Heading-delimited sections of Markdown texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def sections(docs: DataFrame, id_col: str = "doc_path", text_col: str = "text") -> DataFrame:
    """(id, pos, header_level, header_path, text, node_id, prev_id, next_id): one row per non-blank section.

    A section starts at a line of one to six # and a space, outside ``` fences; text before the first heading is a
    section of level 0. header_path has the headings above and its own. Links follow the order within a text.
    """
    # pieces outside fences are cut at their headings; every piece that starts with none goes on the section before it
    pieces = (
        f"flatten(transform(split(`{text_col}`, r'(?m)^(?=```)'), (p, i) -> if(i % 2 = 1, array(named_struct('text', p, 'head', false)), "
        "transform(split(p, r'(?m)(?=^#{1,6} )'), s -> named_struct('text', s, 'head', s rlike '^#{1,6} ')))))"
    )
    each = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(F.expr(pieces)).alias("piece", "x")).select(id_col, "piece", "x.text", "x.head")
    # a piece belongs to the last head before it; numbers instead of growing arrays keep this linear in the headings
    each = each.withColumn("at", F.count_if("head").over(Window.partitionBy(id_col).orderBy("piece")))
    parts = each.groupBy(id_col, "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"]), "").alias("part"))
    parts = parts.where(F.trim(F.regexp_replace("part", r"\s", "")) != "")
    level = F.length(F.regexp_extract("part", r"^(#{1,6}) ", 1))
    title = F.trim(F.regexp_extract("part", r"^#{1,6} ([^\n]*)", 1))
    w = Window.partitionBy(id_col).orderBy("at")
    rows = parts.select(id_col, "at", level.alias("header_level"), title.alias("title"), F.regexp_replace("part", r"\s+$", "").alias("text"))
    rows = rows.withColumn("pos", F.row_number().over(w) - 1)
    for k in range(1, 7):  # the last heading of level k that no later, higher one closes
        mine = F.last(F.when((F.col("header_level") > 0) & (F.col("header_level") <= k), F.struct(F.col("header_level").alias("l"), F.col("title").alias("t"))), ignorenulls=True).over(w)
        rows = rows.withColumn(f"_h{k}", F.when((mine["l"] == k) & (F.col("header_level") >= k), mine["t"]))
    rows = rows.withColumn("header_path", F.array_compact(F.array(*[F.col(f"_h{k}") for k in range(1, 7)]))).drop(*[f"_h{k}" for k in range(1, 7)])
    rows = rows.withColumn("node_id", F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), F.col("pos").cast("string")), 256))
    order = Window.partitionBy(id_col).orderBy("pos")
    return rows.select(id_col, "pos", "header_level", "header_path", "text", "node_id", F.lag("node_id").over(order).alias("prev_id"), F.lead("node_id").over(order).alias("next_id"))


def linked(rows: DataFrame, keys: list[str], order: str, node: str) -> DataFrame:
    """rows with prev_id and next_id of their neighbours within keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumns({"prev_id": F.lag(node).over(w), "next_id": F.lead(node).over(w)})
