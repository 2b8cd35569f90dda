"""Collection of a source's stored answers: query variations, pages that follow a cursor, and a cap of new items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.metrics import observation_identity


def reached(pages: DataFrame, max_pages: int) -> DataFrame:
    """The pages (provider, variation, page, next_cursor and others) that following cursors gets to.

    A page is reached if all before it gave a cursor that no earlier page of the variation had given, and max_pages allow it.
    """
    c = F.col
    variation = Window.partitionBy("provider", "variation")
    again = F.row_number().over(Window.partitionBy("provider", "variation", "next_cursor").orderBy("page")) > 1
    rows = pages.withColumn("__stop", F.coalesce(c("next_cursor") == "", F.lit(True)) | again)
    before = variation.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"__n": F.row_number().over(variation.orderBy("page")), "__stopped": F.coalesce(F.bool_or("__stop").over(before), F.lit(False))})
    return rows.where(~c("__stopped") & (c("__n") <= max_pages)).drop("__stop", "__n", "__stopped")


def collected(leads: DataFrame, pages: DataFrame, max_pages: int, max_items: int) -> DataFrame:
    """Leads (provider, variation, page, position and a lead's columns) of reached pages up to the max_items-th new one of their source, with `duplicate`.

    An identity counts once for a source, over all its variations; what comes after the cap is never looked at.
    """
    c = F.col
    rows = leads.join(reached(pages, max_pages).select("provider", "variation", "page"), ["provider", "variation", "page"], "left_semi").withColumn("__id", observation_identity())
    place = ["variation", "page", "position"]
    rows = rows.withColumn("duplicate", F.row_number().over(Window.partitionBy("provider", "__id").orderBy(*place)) > 1)
    # at most max_items new leads of a source are ranked: a bound that Spark applies before the shuffle
    last = rows.where(~c("duplicate")).withColumn("__n", F.row_number().over(Window.partitionBy("provider").orderBy(*place))).where(c("__n") <= max_items)
    last = last.groupBy("provider").agg(F.max(F.struct(*place)).alias("__last"), (F.max("__n") >= max_items).alias("limit_reached"))
    return rows.join(last, "provider").where(~c("limit_reached") | (F.struct(*place) <= c("__last"))).drop("__id", "__last")


def variation_metrics(leads: DataFrame, pages: DataFrame, max_pages: int, max_items: int) -> DataFrame:
    """provider, variation and counts: raw and rejected rows of the pages that were read, new and duplicate leads, pages, and whether the cap ended it."""
    found = collected(leads, pages, max_pages, max_items)
    counts = found.groupBy("provider", "variation").agg(F.count_if(~F.col("duplicate")).alias("new"), F.count_if("duplicate").alias("duplicates"))
    ends = found.groupBy("provider").agg(F.max(F.struct("variation", "page")).alias("__end"), F.bool_or("limit_reached").alias("limit_reached"))
    read = reached(pages, max_pages).join(ends, "provider", "left").where(~F.coalesce("limit_reached", F.lit(False)) | (F.struct("variation", "page") <= F.col("__end")))
    totals = read.groupBy("provider", "variation").agg(F.sum("raw").alias("raw"), F.sum("rejected").alias("rejected"), F.count(F.lit(1)).alias("pages"), F.bool_or(F.coalesce("limit_reached", F.lit(False))).alias("limit_reached"))
    return totals.join(counts, ["provider", "variation"], "left").select("provider", "variation", "raw", "rejected", F.coalesce("duplicates", F.lit(0)).cast("long").alias("duplicates"), F.coalesce("new", F.lit(0)).cast("long").alias("new"), "pages", "limit_reached")
