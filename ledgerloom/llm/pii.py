"""Personal data: fixed patterns, and terms that corpus co-occurrence shows to reveal a protected value."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, prepare

#: Kinds of spans in their order; from the fifth on they are the method's own.
KINDS = ("email", "ip", "card", "phone", "term", "removed", "secret")
TERM, REMOVED, SECRET = 4, 5, 6
#: Words on either side that make up surroundings. Co-occurrence itself is counted over whole texts.
WINDOW = 8
#: A term must stand with the value in so many documents, and in so many different surroundings.
MIN_DOCUMENTS = MIN_SURROUNDINGS = 3
#: Largest share of the documents in which these are alike; where it is more, the documents are copies of each other.
MAX_ALIKE = 0.5
#: Least -log of the chance that a term which has nothing to do with a value stands in so many of its documents.
EVIDENCE = 12.0
#: Share of the value's information that a term must reveal to be generalised, or removed.
GENERALISE, REMOVE = 0.9, 0.98
#: Distinct terms that a task counts before it passes them on.
FLUSH_TERMS = 100_000
BROADCAST_ROWS = 2_000_000

# possessive, so that no text makes them scan a run of digits twice
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGIT_RUNS = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ASSIGNED = re.compile(r"[=:][ \t]{0,3}([\"']?)([A-Za-z0-9+/_.=~-]{12,})")
_NAMES_SECRET = re.compile(r"(?i)(?:token|key|secret|passwd|password|pwd|bearer|credential)s?[\"']?[ \t]{0,3}$")
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # a match needs an @; it starts where the run of local characters before it starts
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    # of a run of numbers joined by dots every four in turn are a match
    for run in _NUMBERS.finditer(text):
        parts = run.group().split(".")
        if len(parts) < 4:
            continue
        start = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield start, end
            start = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for run in _DIGIT_RUNS.finditer(text):
        if run.end() - run.start() >= 12:
            digits = run.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield run.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for run in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, run.group())) <= 15:
            yield run.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start, then kind."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if any(d in text for d in "0123456789"):
        out += [(s, 1, e) for s, e in _addresses(text)] if "." in text else []
        out += [(s, 2, e) for s, e in _cards(text)]
        out += [(s, 3, e) for s, e in _phones(text)] if "+" in text else []
    return sorted(out)


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, SECRET, end) of credentials: what is assigned to a name such as token, key or password, if it is quoted or holds digits."""
    out = []
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            if (m.group(1) or sum(map(str.isdigit, m.group(2))) > 1) and _NAMES_SECRET.search(text, max(0, m.start() - 24), m.start()):
                out.append((m.start(2), SECRET, m.end(2)))
    return out


def protected_spans(text: str) -> list[tuple[int, int, int]]:
    return sorted(base_spans(text) + secret_spans(text))


def entities(text: str, kind: int) -> list[str]:
    """What a span's text makes known: its value and, for an address or number, whose it is (domain, network, exchange)."""
    value = _value(text, kind)
    if kind == 0:
        return [f"0:{value}", f"domain:{value.rpartition('@')[2]}"]
    if kind == 1:
        return [f"1:{value}", f"network:{value.rpartition('.')[0]}"]
    return [f"3:{value}", f"exchange:{value[:-4]}"] if kind == 3 else [f"{kind}:{value}"]


def _hash(text: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))).astype(np.int64))


def _value(text: str, kind: int) -> str:
    if kind == SECRET:
        return text
    return text.lower() if kind < 2 else "".join(c for c in text if "0" <= c <= "9")


def term_of(word: str) -> str:
    """A word as a term: lower case, without punctuation at its ends."""
    return word.strip(_EDGE).lower()


def free_words(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Places (start, end) of the words, which of them are no part of a span, and for each span its first word and the one after its last."""
    words = np.fromiter((x for m in _WORD.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)
    starts = words[:, 0]
    free = np.ones(len(words), bool)
    bounds = []
    for s, _, e in spans:
        first = max(int(np.searchsorted(starts, s, "right")) - 1, 0)
        bounds.append((first, int(np.searchsorted(starts, e, "left"))))
        free[first : bounds[-1][1]] = False
    return words, free, bounds


def surroundings(text: str, wanted: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each wanted entity (hash) with the terms of the text, and the least hash of the words that surround each: the entity's span, if the
    term is within WINDOW words of it, else the term. Surroundings that differ in few words mostly have it in common."""
    spans = protected_spans(text)
    words, free, bounds = free_words(text, spans)
    numbers: dict[str, int] = {}  # terms in order of their first places; 0 is no term
    ids = np.fromiter((numbers.setdefault(term_of(text[s:e]), len(numbers) + 1) if f else 0 for (s, e), f in zip(words.tolist(), free.tolist(), strict=True)), np.int64, len(words))
    empty = numbers.get("", 0)
    hashes = np.array([0, *map(_hash, numbers)], np.int64)
    first_place = np.full(len(hashes), -1, np.int64)
    at = np.flatnonzero(ids)[::-1]
    first_place[ids[at]] = at

    def window(first: int, last: int) -> np.ndarray:
        """Terms on both sides."""
        near = np.concatenate([ids[max(0, first - WINDOW) : first], ids[last : last + WINDOW]])
        return near[(near > 0) & (near != empty)]

    def around(first: int, last: int) -> int:
        return int(hashes[window(first, last)].min(initial=np.iinfo(np.int64).max))

    known = np.array([k for k in range(1, len(hashes)) if k != empty], np.int64)
    far = np.zeros(len(hashes), np.int64)
    far[known] = [around(i, i + 1) for i in first_place[known].tolist()]
    near: dict[int, np.ndarray] = {}
    for (s, kind, e), (first, last) in zip(spans[::-1], bounds[::-1], strict=True):  # of several the first one counts
        for value in wanted.intersection(map(_hash, entities(text[s:e], kind))):
            near.setdefault(value, far.copy())[window(first, last)] = around(first, last)
    for value, here in near.items():
        yield value, hashes[known], here[known]


_SCAN = "n_email long, n_ip long, n_card long, n_phone long, n_secret long, base array<struct<start:int,kind:int,end:int>>, secrets array<struct<start:int,kind:int,end:int>>, values array<long>"


def scan(text: Column) -> Column:
    @F.pandas_udf(_SCAN)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                t = t or ""
                base, secrets = base_spans(t), secret_spans(t)
                kinds = [k for _, k, _ in base]
                values = sorted({_hash(x) for s, k, e in base + secrets for x in entities(t[s:e], k)})
                rows.append((*(kinds.count(k) for k in range(4)), len(secrets), *([{"start": s, "kind": k, "end": e} for s, k, e in spans] for spans in (base, secrets)), values))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "n_secret", "base", "secrets", "values"])
        give_back()

    return run.asNondeterministic()(text)


def document_frequencies(texts: DataFrame) -> DataFrame:
    """term (hash), documents: in how many of the texts (column text) each term stands. Tasks pass on counts, never words' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def passed() -> pa.RecordBatch:
            terms = np.fromiter((_hash(t) for t in counts), np.int64, len(counts))
            batch = pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], ["term", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for term in {w.strip(_EDGE) for w in _WORD.findall((t or "").lower())}:
                    counts[term] = counts.get(term, 0) + 1
                if len(counts) > FLUSH_TERMS:
                    yield passed()
        if counts:
            yield passed()
        give_back()

    return texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("documents"))


def places(text: Column, telling) -> Column:
    """Where terms of the broadcast table (hash to kind) stand in a text, outside the spans of patterns."""

    @F.pandas_udf("array<struct<start:int,kind:int,end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kinds: dict[str, int] = {}  # of words seen before; 0 if they tell nothing

        def kind_of(word: str) -> int:
            term = term_of(word)
            kind = kinds[word] = telling.value.get(_hash(term), 0) if term else 0
            return kind

        def found(t: str) -> list[dict]:
            hits = {w for w in set(_WORD.findall(t)) if (kinds[w] if w in kinds else kind_of(w))}
            if not hits:
                return []
            words, free, _ = free_words(t, protected_spans(t))
            return [{"start": s, "kind": kinds[t[s:e]], "end": e} for (s, e), f in zip(words.tolist(), free.tolist(), strict=True) if f and t[s:e] in hits]

        for texts in batches:
            rows = []
            for t in texts:
                rows.append(found(t or ""))
                if len(kinds) > FLUSH_TERMS:
                    kinds.clear()
            yield pd.Series(rows, dtype=object)
        give_back()

    return run.asNondeterministic()(text)


class Sanitiser:
    """Personal data of documents (doc_id, text and any others).

    Patterns find e-mail addresses, IP addresses, card and phone numbers, and credentials that are assigned to a name. What
    they make known is protected: the values, and whose they are (an address's domain, a number's exchange). For each such entity c and each term t of the
    texts that hold it, the corpus gives the pointwise mutual information of c and t over the information of c, by
    document frequencies: log(N df(c,t) / df(c) df(t)) / log(N / df(c)). It is 1 if t stands only with c. Terms that
    reach GENERALISE become a span `term` wherever they stand in any text, those that reach REMOVE a span `removed`, given
    MIN_DOCUMENTS documents, MIN_SURROUNDINGS different surroundings of which none makes up more than MAX_ALIKE of all (near
    copies of one text are no evidence), and an agreement beyond chance (df(c,t) log(N / df(c)) of EVIDENCE or more). Pairs are counted before their
    surroundings are, and surroundings only of pairs that reach GENERALISE. An entity of all documents has no
    information to reveal.

    Null and empty texts have no spans. Repeated rows count as documents, but equal surroundings once. Null doc_ids get their rows. Texts count
    whole, whatever their length. A frequent entity is counted by partial sums; no group is gathered. Empty table: no rows. Spans stand in order of
    start, kind, end. Other columns are kept by clean() and ignored by spans(), whatever their names.
    """

    def __init__(self, docs: DataFrame):
        prepare(docs.sparkSession)
        self.docs = docs
        slim = docs.select("doc_id", "text").select("doc_id", F.xxhash64("text").alias("digest"), scan(F.col("text")).alias("s"))
        self.rows = materialize(slim.select("doc_id", "digest", "s.*"), "pii-rows")

    def pairs(self, values: DataFrame) -> DataFrame:
        """value, term, around: a row for each of the values that a text holds and each term of that text."""
        held = self.rows.select("digest", "values").dropDuplicates(["digest"]).select("digest", F.explode("values").alias("value")).join(values.select("value"), "value")
        held = materialize(held.groupBy("digest").agg(F.collect_list("value").alias("values")), "pii-held")
        held = F.broadcast(held) if held.count() <= BROADCAST_ROWS else held
        texts = self.docs.select("text", F.xxhash64("text").alias("digest")).join(held, "digest").select("text", "values")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for value, found, around in surroundings(text or "", set(wanted)):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), value)), pa.array(found), pa.array(around)], ["value", "term", "around"])
            give_back()

        return texts.mapInArrow(run, "value long, term long, around long")

    def telling(self) -> DataFrame:
        """term (hash) and kind of the terms that reveal a value."""
        n = self.rows.count()
        values = self.rows.select(F.explode("values").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("of_value"))
        values = materialize(values.where((F.col("of_value") >= MIN_DOCUMENTS) & (F.col("of_value") < n)), "pii-values")
        pairs = self.pairs(values)
        counts = materialize(pairs.groupBy("value", "term").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= MIN_DOCUMENTS), "pii-pairs")
        terms = document_frequencies(self.docs.select("text")).join(counts.select("term").distinct(), "term")
        told = counts.join(values, "value").join(terms, "term")
        share = F.log(F.lit(float(n)) * F.col("together") / (F.col("of_value") * F.col("documents"))) / F.log(F.lit(float(n)) / F.col("of_value"))
        kind = F.when(F.col("share") >= REMOVE, F.lit(REMOVED)).otherwise(F.lit(TERM)).alias("kind")
        beyond = F.col("together") * F.log(F.lit(float(n)) / F.col("of_value")) >= EVIDENCE
        likely = materialize(told.where(beyond).withColumn("share", share).where(F.col("share") >= GENERALISE).select("value", "term", kind), "pii-likely")
        alike = pairs.join(likely, ["value", "term"]).groupBy("value", "term", "kind", "around").agg(F.count(F.lit(1)).alias("n"))
        ways = alike.groupBy("value", "term", "kind").agg(F.count(F.lit(1)).alias("ways"), F.max("n").alias("most"), F.sum("n").alias("n"))
        told = ways.where((F.col("ways") >= MIN_SURROUNDINGS) & (F.col("most") <= F.col("n") * MAX_ALIKE))
        return materialize(told.groupBy("term").agg(F.max("kind").alias("kind")), "pii-telling")

    def added(self) -> DataFrame:
        """doc_id, digest (xxhash64 of the text) and extra, the method's spans: a row for each text that has any."""
        telling = self.telling()
        spark, rounds = self.docs.sparkSession, -(-telling.count() // BROADCAST_ROWS)
        texts = self.docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
        found = None
        for i in range(rounds):  # each holds as many terms as fit
            part = telling.where(F.pmod("term", F.lit(rounds)) == i).toPandas()
            some = texts.select("doc_id", "digest", F.explode(places(F.col("text"), spark.sparkContext.broadcast(dict(zip(part["term"].tolist(), part["kind"].tolist(), strict=True))))).alias("s"))
            found = some if found is None else found.union(some)
        if found is None:
            return texts.limit(0).select("doc_id", "digest", F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("extra"))
        return found.distinct().groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list("s")).alias("extra"))

    @staticmethod
    def _joined(spans: Column) -> Column:
        name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")

    def spans(self) -> DataFrame:
        """One row per row of docs: doc_id, counts by kind of pattern, base_sha256, spans, n_secret, n_terms, and whether there is any span."""
        none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
        extra = self.added().select(F.col("doc_id").alias("__doc"), F.col("digest").alias("__digest"), "extra")
        same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("digest").eqNullSafe(F.col("__digest"))
        every = F.array_sort(F.concat("base", "secrets", F.coalesce("extra", none)))
        joined = self.rows.drop("values").join(extra, same, "left").withColumn("every", every)
        return joined.select(
            "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(self._joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), self._joined(F.col("every")).alias("spans"),
            "n_secret", F.size(F.coalesce("extra", none)).cast("long").alias("n_terms"), (F.size("every") > 0).alias("personal"),
        )

    def clean(self) -> DataFrame:
        """docs with their texts' spans replaced by [KIND], or removed, and n_chars, where there is such a column, as it then is.

        Overlapping spans are replaced as one, named after the first. Null texts stay null.
        """
        extra = materialize(self.added(), "pii-extra")
        extra = F.broadcast(extra) if extra.count() <= BROADCAST_ROWS else extra
        rows = self.docs.select(F.struct("*").alias("document"), F.xxhash64("text").alias("of"))
        same = F.col("document.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("digest"))
        out = rows.join(extra, same, "left").select("document", cleaned(F.col("document.text"), F.col("extra")).alias("clean"))
        changed = F.col("document").withField("text", F.col("clean"))
        if "n_chars" in self.docs.columns:
            changed = changed.withField("n_chars", F.char_length("clean").cast(self.docs.schema["n_chars"].dataType))
        return out.select(changed.alias("document")).select("document.*")


def cleaned(text: Column, extra: Column) -> Column:
    """The text with its pattern spans and the extra spans replaced."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, extras in batches:
            yield pd.Series([t if t is None else replace(t, [*protected_spans(t), *((s["start"], s["kind"], s["end"]) for s in (() if x is None else x))]) for t, x in zip(texts, extras, strict=True)], dtype=object)
        give_back()

    return run.asNondeterministic()(text, extra)


def replace(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for s, kind, e in sorted(spans):
        if s >= at:
            out += [text[at:s], "" if kind == REMOVED else f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def base_digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
