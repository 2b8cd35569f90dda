"""Stored companies: best match, insertion, enrichment, evidence rows, data-quality checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import normalize_url
from .graph import connected_components, cut


def match_scores(resolved: DataFrame, stored: DataFrame) -> DataFrame:
    """rank, company_id, score of each pair of a resolved row and a stored company that may be the same.

    resolved: rank, name, cnpj, phone, whatsapp, website, city, state, address; stored: company_id and the same. Candidates
    share a name, tax id, number (phone or WhatsApp on either side) or website: one equi-join on keys, not a join with OR.
    Different tax ids exclude a pair. Tax id 100, number 50, website 30, name with city or address 20; pairs of 0 drop out.
    """
    c = F.col

    def keys(df: DataFrame, row: str) -> DataFrame:
        k = lambda kind, v: F.when(v.isNotNull(), F.concat(F.lit(kind), v))
        every = F.array_distinct(F.array_compact(F.array(k("n:", T.fingerprint(T.company_name(c("name")))), k("c:", c("cnpj")), k("p:", c("phone")), k("p:", c("whatsapp")), k("w:", normalize_url(c("website"))))))
        # dealt to all tasks first: a file of few row groups would leave the work to as many
        return df.repartition(row).select(row, F.explode(every).alias("key"))

    pairs = keys(resolved, "rank").join(keys(stored, "company_id"), "key").select("rank", "company_id").distinct()
    names = ("name", "cnpj", "phone", "whatsapp", "website", "city", "state", "address")
    side = lambda df, row, x: df.select(row, *[c(n).alias(f"{x}_{n}") for n in names])
    rows = pairs.join(side(resolved, "rank", "r"), "rank").join(side(stored, "company_id", "s"), "company_id")
    yes = lambda x: F.coalesce(x, F.lit(False))
    numbers = lambda x: F.array_compact(F.array(F.nullif(c(f"{x}_phone"), F.lit("")), F.nullif(c(f"{x}_whatsapp"), F.lit(""))))
    same = lambda n: yes(T.normalize_text(c(f"r_{n}")) == T.normalize_text(c(f"s_{n}")))
    city = same("city") & (c("s_state").isNull() | c("r_state").isNull() | same("state"))
    name = yes(T.company_name(c("r_name")) == T.company_name(c("s_name")))
    score = (
        F.when(yes(c("r_cnpj") == c("s_cnpj")), 100).otherwise(0) + F.when(yes(F.arrays_overlap(numbers("r"), numbers("s"))), 50).otherwise(0)
        + F.when(yes(normalize_url(c("r_website")) == normalize_url(c("s_website"))), 30).otherwise(0) + F.when(name & (city | same("address")), 20).otherwise(0)
    )
    return rows.where(~yes(c("r_cnpj") != c("s_cnpj"))).select("rank", "company_id", score.cast("int").alias("score")).where("score > 0")


#: A block of so many pairs is settled by one task; greater ones in rounds.
BLOCK_PAIRS = 20_000


def _in_turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The choices within blocks, whose pairs come one block after another by rank, score and company."""
    now, last, taken = None, None, set()
    for pairs in batches:
        out = []
        for block, rank, company, score in zip(*[pairs[x].tolist() for x in ("block", "rank", "company_id", "score")], strict=True):
            if block != now:
                now, last, taken = block, None, set()
            if rank != last and company not in taken:
                taken.add(company)
                out.append((rank, company, score))
                last = rank
        yield pd.DataFrame(out, columns=["rank", "company_id", "score"])


def assign(scores: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """rank, company_id, score: each rank in turn takes the best company that none before it has; ties to the greater id.

    Ranks only compete within a connected block of candidates. Blocks of up to block_pairs pairs are settled in one pass. In greater
    ones rounds settle, in all at once, each rank whose choice no earlier rank of the block can still want; a block's least open
    rank always settles, so it ends. Both give the same choices.
    """
    scores = cut(scores.select("rank", "company_id", "score"))
    told = cut(scores.join(blocks(scores), "rank"))
    great = told.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_pairs).select("block")
    small = told.join(great, "block", "left_anti").select("block", "rank", "company_id", "score")
    settled = cut(small.repartition("block").sortWithinPartitions("block", "rank", F.desc("score"), F.desc("company_id")).mapInPandas(_in_turn, scores.schema))
    open_pairs = cut(told.join(great, "block", "left_semi").select("rank", "company_id", "score"))
    while not open_pairs.isEmpty():
        # a rank may choose when no earlier open rank has any of its candidates
        first = open_pairs.groupBy("company_id").agg(F.min("rank").alias("least"))
        told = open_pairs.join(first, "company_id")
        free = told.groupBy("rank").agg(F.bool_and(F.col("rank") == F.col("least")).alias("free"), F.max(F.struct("score", "company_id")).alias("best")).where("free")
        done = cut(free.select("rank", "best.company_id", "best.score"))
        settled = settled.union(done)
        open_pairs = cut(open_pairs.join(done.select("rank"), "rank", "left_anti").join(done.select("company_id"), "company_id", "left_anti"))
    return settled


def new_companies(resolved: DataFrame) -> DataFrame:
    """Rows to insert: normalised name, its fingerprint, and the states of a company that nobody has verified."""
    return resolved.withColumns({
        "normalized_name": T.company_name(F.col("name")), "name_fingerprint": T.fingerprint(T.company_name(F.col("name"))), "website": normalize_url(F.col("website")),
        "whatsapp_status": F.when(F.col("whatsapp").isNotNull(), "unconfirmed").otherwise("not_found"), "validation_status": F.lit("unverified"),
    })


FILLED = ("phone", "address", "city", "state", "category", "instagram", "cnpj")


def enriched(pairs: DataFrame) -> DataFrame:
    """Stored rows (s_*) with what their resolved rows (r_*) add: only nulls are filled.

    A confirmed number always wins, an unconfirmed one never replaces a confirmed one; without a decision (r_status
    null) a number only fills a gap. Confidence is the greater.
    """
    c = F.col
    fill = lambda n: F.coalesce(F.nullif(c(f"s_{n}"), F.lit("")), c(f"r_{n}")).alias(n)
    takes = F.when(c("r_status") == "confirmed", True).when(c("r_status") == "unconfirmed", c("s_status") != "confirmed").when(c("r_status").isNull(), c("s_whatsapp").isNull() & c("r_whatsapp").isNotNull()).otherwise(False)
    status = F.when(c("r_status").isNull(), F.lit("unconfirmed")).otherwise(c("r_status"))
    return pairs.select(
        "company_id", *[fill(n) for n in FILLED], F.coalesce(c("s_website"), normalize_url(c("r_website"))).alias("website"),
        F.when(takes, c("r_whatsapp")).otherwise(c("s_whatsapp")).alias("whatsapp"), F.when(takes, status).otherwise(c("s_status")).alias("whatsapp_status"),
        F.greatest(F.coalesce("s_confidence", F.lit(0)), "r_confidence").alias("confidence"),
    )


def phone_evidence(resolved: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence rows of the chosen phones: official records of the same number, distinct by value, type and page."""
    from ..functions.phones import normalize_phone

    rows = evidence.where(F.col("field") == "phone").withColumn("normalized_value", normalize_phone(F.col("value")))
    joined = resolved.select("company_id", F.col("phone").alias("chosen")).join(rows, "company_id").where(F.col("normalized_value") == F.col("chosen"))
    return joined.select("company_id", "normalized_value", "evidence_type", "source_url", "excerpt").dropDuplicates(["company_id", "normalized_value", "evidence_type", "source_url"])


def violations(companies: DataFrame) -> DataFrame:
    """company_id and rule of each stored row that breaks a constraint of the table."""
    c = F.col
    rules = {
        "confidence_range": ~c("confidence").between(0, 100),
        "confirmed_needs_number": (c("whatsapp_status") == "confirmed") & c("whatsapp").isNull(),
        "number_needs_status": c("whatsapp").isNotNull() & (c("whatsapp_status") == "not_found"),
        "tax_id_shape": ~c("cnpj").rlike("^[0-9]{14}$"),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))
    return companies.select("company_id", F.explode(broken).alias("rule"))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that should be unique and aren't, with their number."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def within_budget(entries: DataFrame, max_entries: int, max_bytes: int, by: list[str]) -> DataFrame:
    """Cache entries (last_access, bytes of 0 or more) that stay: the most recent ones within both bounds, ties by key.

    Entries of a minute are summed first; only minutes in which the bounds aren't used up yet are sorted, each by itself.
    """
    c = F.col
    slot = F.date_trunc("minute", "last_access")
    rows = lambda to: Window.partitionBy(*by).orderBy(F.desc("__slot")).rowsBetween(Window.unboundedPreceding, to)
    sums = entries.groupBy(*by, slot.alias("__slot")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    before = sums.select(*[c(x).alias(f"__k{i}") for i, x in enumerate(by)], "__slot", *[F.coalesce(F.sum(x).over(rows(-1)), F.lit(0)).alias(f"__{x}0") for x in "nb"])
    same = c("__at").eqNullSafe(c("__slot"))
    for i, x in enumerate(by):
        same = same & c(x).eqNullSafe(c(f"__k{i}"))
    left = entries.withColumn("__at", slot).join(before.where((c("__n0") < max_entries) & (c("__b0") <= max_bytes)), same)
    w = Window.partitionBy(*by, "__at").orderBy(F.desc("last_access"), "key")
    told = left.withColumns({"__n": c("__n0") + F.row_number().over(w), "__b": c("__b0") + F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))})
    return told.where((c("__n") <= max_entries) & (c("__b") <= max_bytes)).select(*entries.columns)


def blocks(scores: DataFrame) -> DataFrame:
    """rank and the block of candidates in which it competes."""
    edges = scores.select(F.concat(F.lit("r"), "rank").alias("a"), F.concat(F.lit("s"), "company_id").alias("b"))
    return connected_components(edges).where(F.col("node").startswith("r")).select(F.substring("node", F.lit(2), F.length("node")).cast("long").alias("rank"), F.col("root").alias("block"))
