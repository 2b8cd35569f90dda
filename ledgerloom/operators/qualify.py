"""Qualification of companies against a requested category: sanitised context, fixed rules, batches for a classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MAX_SOURCES = 6
REASONS = {
    "none": "no category requested",
    "unreadable": "requested category has no usable words",
    "exact": "observed category equals the requested one",
    "other": "observed category belongs to another segment",
    "all": "all words appear in the observed category",
    "most": "most words appear in the observed category",
    "evidence": "all words appear in public evidence",
    "model": "decided by the classifier from the evidence cited",
    "unknown": "evidence neither confirms nor excludes the category",
}


def with_context(companies: DataFrame) -> DataFrame:
    """companies (requested, category, name, address, city, state, source_texts) with q, c, n and s: what a classifier may see.

    Contacts, numbers and known places are removed; of the source texts the first MAX_SOURCES that say something new stay.
    """
    c = F.col
    rows = companies.withColumns({"q": T.sanitize(c("requested")), "c": T.sanitize(c("category")), "n": T.sanitize(c("name"))})
    texts = F.transform(F.coalesce("source_texts", F.array().cast("array<string>")), lambda t: T.remove_locations(T.sanitize(t), c("address"), c("city"), c("state")))
    told = F.array_compact(F.array(T.normalize_text(c("q")), T.normalize_text(c("c")), T.normalize_text(c("n"))))
    keyed = F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: F.struct(T.normalize_text(t).alias("k"), t.alias("v")))
    fresh = F.aggregate(
        keyed, F.array().cast("array<struct<k:string,v:string>>"),
        lambda acc, x: F.when((x["k"] == "") | F.array_contains(told, x["k"]) | F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return rows.withColumn("s", F.transform(F.slice(fresh, 1, MAX_SOURCES), lambda x: x["v"]))


def deterministic(rows: DataFrame) -> DataFrame:
    """Rows of with_context() with category_match (null: unknown), qualification_confidence, reason, method and refs."""
    c = F.col
    q, o = T.category_tokens(c("q")), T.category_tokens(c("c"))
    share = T.coverage(q, F.coalesce(o, F.array().cast("array<string>")))
    asked, seen = T.known_concepts(c("q")), T.known_concepts(c("c"))
    other = (F.size(asked) > 0) & (F.size(seen) > 0) & ~F.arrays_overlap(asked, seen)
    full = lambda t: T.coverage(q, T.category_tokens(t)) == 1.0
    which = F.array_position(F.transform("s", full), F.lit(True))
    observed = c("c").isNotNull()
    verdict = lambda match, score, reason, ref: F.struct(F.lit(match).cast("boolean").alias("match"), F.lit(score).alias("score"), F.lit(REASONS[reason]).alias("reason"), ref.alias("ref"))
    none = F.lit(None).cast("string")
    out = (
        F.when(c("q").isNull(), verdict(None, 100, "none", none))
        .when(F.size(q) == 0, verdict(None, 25, "unreadable", none))
        .when(observed & (T.normalize_text(c("q")) == T.normalize_text(c("c"))), verdict(True, 99, "exact", F.lit("C1")))
        .when(observed & other, verdict(False, 95, "other", F.lit("C1")))
        .when(observed & (share == 1.0), verdict(True, 96, "all", F.lit("C1")))
        .when(observed & (share >= 0.67), verdict(True, 88, "most", F.lit("C1")))
        .when(c("n").isNotNull() & full(c("n")), verdict(True, 82, "evidence", F.lit("N1")))
        .when(which > 0, verdict(True, 80, "evidence", F.concat(F.lit("S"), which)))
        .otherwise(verdict(None, 25, "unknown", none))
    )
    refs = F.array_join(F.array_compact(F.array(F.when(c("q").isNotNull(), F.lit("Q1")), c("v.ref"))), ",")
    return rows.withColumn("v", out).select("*", c("v.match").alias("category_match"), c("v.score").alias("qualification_confidence"), c("v.reason").alias("qualification_reason"), F.lit("deterministic").alias("qualification_method"), refs.alias("refs")).drop("v")


def needs_classifier(budget: int, configured: bool = True) -> Column:
    """Rows that the rules leave open and that have evidence about the company."""
    return F.col("category_match").isNull() & F.col("q").isNotNull() & (F.col("n").isNotNull() | F.col("c").isNotNull() | (F.size("s") > 0)) & F.lit(configured and budget > 0)


def refs_valid(refs: Column, allowed: Column, decided: Column) -> Column:
    """Whether all refs are allowed and a decision cites something about the company, not only the request."""
    about = F.filter(allowed, lambda x: x != "Q1")
    return (F.size(F.array_except(refs, allowed)) == 0) & (~decided | F.coalesce(F.arrays_overlap(refs, about), F.lit(False)))


def source_texts(sources: Column) -> Column:
    """What a company's sources say of it that a classifier may see; their data is a JSON array of (key, value)."""
    entries = F.flatten(F.transform(sources, lambda s: F.coalesce(F.from_json(s["data"], "array<struct<key:string,value:string>>"), F.array().cast("array<struct<key:string,value:string>>"))))
    return T.safe_entries(entries)


def with_classifier(judged: DataFrame, classifier: Callable[[pd.DataFrame], pd.DataFrame], budget: int, batch: int) -> DataFrame:
    """Ranked rows of deterministic() (cluster, rank and its columns), of which the first `budget` that the rules leave open are put to a classifier.

    Its answer stands where it decides; at most `budget` rows ever reach it.
    """
    c = F.col
    wanted = judged.where(needs_classifier(budget)).orderBy("rank").limit(budget).select(c("cluster").alias("key"), "q", "c", "n", "s")
    answers = classify(wanted, classifier, batch).where(c("category_match").isNotNull())
    answers = answers.select(c("key").alias("cluster"), c("category_match").alias("a_match"), c("confidence").alias("a_confidence"), F.array_join("refs", ",").alias("a_refs"))
    said = c("a_match").isNotNull()
    rows = judged.join(F.broadcast(answers), "cluster", "left")
    return rows.withColumns({
        "category_match": F.coalesce("a_match", "category_match"), "qualification_confidence": F.when(said, c("a_confidence")).otherwise(c("qualification_confidence")),
        "qualification_method": F.when(said, F.lit("model")).otherwise(c("qualification_method")), "qualification_reason": F.when(said, F.lit(REASONS["model"])).otherwise(c("qualification_reason")), "refs": F.coalesce("a_refs", "refs"),
    }).drop("a_match", "a_confidence", "a_refs")


def classify(rows: DataFrame, classifier: Callable[[pd.DataFrame], pd.DataFrame], batch: int = 10) -> DataFrame:
    """Rows with key, batch and context put through a pluggable classifier, batch by batch: key, category_match, confidence, refs.

    The classifier sees ref, q, c, n and s and returns ref, category_match, confidence and refs. Refs that it makes up void its
    answer; rows without an answer stay open.
    """
    schema = "key long, category_match boolean, confidence int, refs array<string>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch].reset_index(drop=True)
                part["ref"] = [f"C{k + 1}" for k in range(len(part))]
                answers = classifier(part[["ref", "q", "c", "n", "s"]]).set_index("ref")
                known = part.set_index("ref")
                out = []
                for ref, row in known.iterrows():
                    allowed = {"Q1", *(["C1"] if row["c"] else []), *(["N1"] if row["n"] else []), *(f"S{k + 1}" for k in range(len(row["s"])))}
                    a = answers.loc[ref] if ref in answers.index else None
                    fits = a is not None and set(a["refs"]) <= allowed and (a["category_match"] is None or set(a["refs"]) - {"Q1"})
                    out.append((row["key"], a["category_match"] if fits else None, int(a["confidence"]) if fits else 25, list(a["refs"]) if fits else []))
                yield pd.DataFrame(out, columns=["key", "category_match", "confidence", "refs"])

    return rows.select("key", "q", "c", "n", "s").mapInPandas(run, schema)
