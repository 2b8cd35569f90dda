"""Counters and states of searches: discovery, contribution, outcome, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from ..functions import text as T

#: Progress shown at each stage of a search (fixed values).
PROGRESS = {"planning": 5, "discovering": 55, "deduplicating": 65, "enriching": 78, "qualifying": 86, "persisting": 90, "finished": 100}
TERMINAL = ("completed", "partial", "failed", "cancelled")


def observation_identity() -> Column:
    """What tells a source's rows apart: its id, else its page, else what it says."""
    said = F.sha2(F.to_json(F.struct(F.coalesce("name", F.lit("")), F.coalesce("phone", F.lit("")), F.coalesce("address", F.lit("")))).cast("binary"), 256)
    return F.coalesce(F.concat(F.lit("id:"), F.nullif("external_id", F.lit(""))), F.concat(F.lit("url:"), F.nullif("source_url", F.lit(""))), said)


def first_seen(leads: DataFrame, order: list[Column], keep_flags: bool = False) -> DataFrame:
    """Leads of which each source's identity stays once, the first; with keep_flags all rows and `duplicate`."""
    w = Window.partitionBy("provider", "__identity").orderBy(*order)
    rows = leads.withColumn("__identity", observation_identity()).withColumn("__n", F.row_number().over(w))
    if keep_flags:
        return rows.withColumn("duplicate", F.col("__n") > 1).drop("__identity", "__n")
    return rows.where("__n = 1").drop("__identity", "__n")


def capped(leads: DataFrame, order: list[Column], most: int) -> DataFrame:
    """At most `most` leads of each source, with `limit_reached` where there were more.

    One more than that is ranked, a bound that Spark applies before the shuffle; a source of any size costs each task no more.
    """
    w = Window.partitionBy("provider")
    rows = leads.withColumn("__n", F.row_number().over(w.orderBy(*order))).where(F.col("__n") <= most + 1)
    return rows.withColumn("limit_reached", F.max("__n").over(w) > most).where(F.col("__n") <= most).drop("__n")


def discovery(leads: DataFrame, with_totals: bool = False) -> DataFrame:
    """provider, variation and counts of raw, rejected, duplicate and new rows and of pages; totals by rollup on demand."""
    counts = [
        F.count(F.lit(1)).alias("raw"), F.count_if("rejected").alias("rejected"), F.count_if(~F.col("rejected") & F.col("duplicate")).alias("duplicates"),
        F.count_if(~F.col("rejected") & ~F.col("duplicate")).alias("new"), F.countDistinct("page").alias("pages"),
    ]
    grouped = leads.rollup("provider", "variation") if with_totals else leads.groupBy("provider", "variation")
    return grouped.agg(*counts)


def contribution(resolved: DataFrame) -> DataFrame:
    """provider, results it takes part in, and results that it alone gives."""
    rows = resolved.select("cluster", F.array_distinct(F.transform("sources", lambda s: T.normalize_text(s["provider"]))).alias("p"))
    return rows.select("cluster", F.size("p").alias("n"), F.explode("p").alias("provider")).groupBy("provider").agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("n") == 1).alias("exclusive"))


def counters(results: DataFrame) -> DataFrame:
    """search_id and counts of results, numbers, confirmed numbers, enriched and classified rows."""
    c = F.col
    return results.groupBy("search_id").agg(
        F.count(F.lit(1)).alias("results"), F.count_if(c("whatsapp").isNotNull()).alias("whatsapp"), F.count_if(c("whatsapp_status") == "confirmed").alias("confirmed"),
        F.count_if(F.coalesce("enriched", F.lit(False))).alias("enriched"), F.count_if(c("qualification_method") != "deterministic").alias("classified"),
    )


def outcome(runs: DataFrame) -> DataFrame:
    """search_id, status and error message of searches from their sources' runs (search_id, provider, succeeded, limit_reached, error).

    Failed if no source succeeded, partial if one failed or was cut short, else completed. Messages are joined in order of
    source, up to 2000 characters.
    """
    c = F.col
    ok = F.bool_or("succeeded")
    partial = F.bool_or(c("error").isNotNull() | F.coalesce("limit_reached", F.lit(False)))
    said = F.array_sort(F.collect_list(F.when(c("error").isNotNull(), F.struct("provider", "error"))))
    message = F.substring(F.array_join(F.transform(said, lambda x: F.concat_ws(": ", x["provider"], x["error"])), "; "), 1, 2000)
    return runs.groupBy("search_id").agg(F.when(~ok, "failed").when(partial, "partial").otherwise("completed").alias("status"), F.nullif(message, F.lit("")).alias("error_message"))


def with_sources_known(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Runs with their source's name; runs of unknown sources drop out."""
    return runs.join(sources, "provider", "inner")


def missing_sources(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """Keys of wanted that sources doesn't have yet."""
    return wanted.join(sources, "provider", "left_anti")


def latest_state(events: DataFrame) -> DataFrame:
    """search_id, stage, status and progress by each search's last event (ties: the greater event id)."""
    last = events.groupBy("search_id").agg(F.max_by(F.struct("stage", "status"), F.struct("ts", "event_id")).alias("s"))
    progress = F.lit(0)
    for stage, n in PROGRESS.items():
        progress = F.when(F.col("stage") == stage, F.lit(n)).otherwise(progress)
    return last.select("search_id", "s.stage", "s.status").withColumn("progress", F.when(F.col("status").isin(*TERMINAL), 100).otherwise(progress).cast("int"))


def recovered(searches: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """Searches of which those that run without a heartbeat have failed, as after a crash."""
    alive = heartbeats.select("search_id").distinct().withColumn("__alive", F.lit(True))
    lost = (F.col("status") == "running") & F.col("__alive").isNull()
    return searches.join(alive, "search_id", "left").withColumn("error_message", F.when(lost, F.lit("interrupted")).otherwise(F.col("error_message"))).withColumn("status", F.when(lost, F.lit("failed")).otherwise(F.col("status"))).drop("__alive")


def request_gaps(requests: DataFrame, least_seconds: float) -> DataFrame:
    """Requests to a host that came sooner than least_seconds after the one before, with that gap.

    A task holds a slot of time of a host, never all of its requests: an hour, or least_seconds if longer. What came before a slot's
    first request is the last one of the slot before; one of an earlier slot is too far back.
    """
    c = F.col
    slots = requests.withColumns({"__slot": F.floor(c("ts").cast("double") / max(3600.0, least_seconds)), "__own": F.lit(1)})
    last = slots.where(c("ts").isNotNull()).groupBy("host", "__slot").agg(F.max("ts").alias("ts")).select("host", (c("__slot") + 1).alias("__slot"), "ts", F.lit(0).alias("__own"))
    before = F.lag("ts").over(Window.partitionBy("host", "__slot").orderBy("__own", "ts", "request_id"))
    gaps = slots.unionByName(last, allowMissingColumns=True).withColumn("gap", c("ts").cast("double") - before.cast("double"))
    return gaps.where((c("__own") == 1) & (c("gap") < least_seconds)).drop("__slot", "__own")


def fresh(entries: DataFrame, now: DataFrame, ttl_seconds: int) -> DataFrame:
    """The newest entry of each key that isn't older than ttl_seconds at `now`, a table of one row."""
    newest = entries.groupBy("key").agg(F.max_by(F.struct("ts", "payload"), "ts").alias("e")).select("key", "e.ts", "e.payload")
    return newest.join(F.broadcast(now), F.col("ts") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > F.col("now")).drop("now")


def enrichment_counters(rows: DataFrame, budget: int, errors: int = 25) -> DataFrame:
    """attempted, enriched, skipped, errors (the first ones in order of company) and whether the budget ran out.

    Only as many error texts as are given out ever meet in a task.
    """
    c = F.col
    said = rows.where(c("error").isNotNull()).select(F.concat_ws(": ", F.lpad(c("company_id").cast("string"), 12, "0"), "error").alias("said")).orderBy("said").limit(errors)
    first = said.agg(F.array_sort(F.collect_list("said")).alias("errors"))
    counts = rows.groupBy().agg(
        F.count_if(c("attempted")).alias("attempted"), F.count_if(c("attempted") & c("error").isNull()).alias("enriched"), F.count_if(~c("attempted")).alias("skipped"), (F.count(F.lit(1)) > budget).alias("limit_reached")
    )
    return counts.join(F.broadcast(first), F.lit(True)).select("attempted", "enriched", "skipped", "errors", "limit_reached")


def classifier_counters(answers: DataFrame) -> DataFrame:
    """calls, cache_hits and diagnostics (distinct, in order of appearance) of a classifier's answers (seq, batch, cached, diagnostic)."""
    c = F.col
    said = answers.where(c("diagnostic").isNotNull()).groupBy("diagnostic").agg(F.min("seq").alias("seq"))
    said = said.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "diagnostic"))), lambda x: x["diagnostic"]).alias("diagnostics"))
    counts = answers.agg(F.count_distinct(F.when(~c("cached"), c("batch"))).alias("calls"), F.count_if("cached").alias("cache_hits"))
    return counts.join(F.broadcast(said), F.lit(True))


#: What names of fields hold whose values logs hide (fixed values).
SENSITIVE = ("api_key", "authorization", "password", "secret", "token")


def _sensitive(name: Column) -> Column:
    out = F.lit(False)
    for part in SENSITIVE:
        out = out | F.contains(T.normalize_text(name), F.lit(part))
    return out


def redacted(value: Column, kind: DataType) -> Column:
    """A value of a type as a log may show it: at any depth of structs, maps and arrays, fields and keys that name secrets are hidden."""
    if isinstance(kind, StructType):
        hide = {f.name: any(x in f.name.casefold() for x in SENSITIVE) for f in kind.fields}
        fields = [(F.when(value[f.name].isNotNull(), F.lit("***")) if hide[f.name] else redacted(value[f.name], f.dataType)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: redacted(x, kind.elementType))
    if isinstance(kind, MapType):
        if isinstance(kind.valueType, StringType):
            return F.transform_values(value, lambda k, v: F.when(_sensitive(k), F.lit("***")).otherwise(v))
        shown = F.map_filter(value, lambda k, v: ~_sensitive(k))
        return F.transform_values(shown, lambda k, v: redacted(v, kind.valueType))
    return value


def run_rows(search_id: Column, variations: DataFrame, errors: DataFrame) -> DataFrame:
    """A row for each source of a search: its counts over all variations, whether it was cut short, its error, and its status.

    variations: provider and counts (sources.paging); errors: provider, error of those that failed.
    """
    c = F.col
    sums = variations.groupBy("provider").agg(*[F.sum(x).alias(x) for x in ("raw", "rejected", "duplicates", "new", "pages")], F.count(F.lit(1)).alias("variations"), F.bool_or("limit_reached").alias("limit_reached"))
    rows = sums.join(errors.groupBy("provider").agg(F.min("error").alias("error")), "provider", "full")
    return rows.select(search_id.alias("search_id"), "*", F.when(c("error").isNull(), "succeeded").when(F.coalesce(c("new"), F.lit(0)) > 0, "partial").otherwise("failed").alias("status"))
