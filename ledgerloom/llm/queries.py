"""Queries of the corpus operators over the test tables, with production parameters, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .ann import nearest
from .common import new_folder
from .lm import held_out, score
from .mixing import mix
from .neardup import fingerprint_components
from .packing import pack
from .pii import Sanitiser
from .quality import judge
from .sharding import ShardStore
from .urlfilter import judge_urls
from .wrappers import main_text

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Hosts of the query's own blocklist: by rule, each of BLOCKED_WORDS with each other one under each of BLOCKED_ZONES.
BLOCKED_WORDS = tuple(
    "ads adult bets bonus cash casino cheap click coupon crack deals diet dating farm free gamble hot jackpot loans lottery lucky pills poker porn prize promo replica slots spam "
    "streams torrent track tracker viagra warez watch win xxx".split()
)
BLOCKED_ZONES = ("example.com", "example.net", "example.org")
BLOCKED = tuple(f"{a}-{b}.{zone}" for a in BLOCKED_WORDS for b in BLOCKED_WORDS if a != b for zone in BLOCKED_ZONES)


#: Arrivals in which the query's documents come to the store.
ARRIVALS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), held_out(F.col("doc_id")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES, BLOCKED)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_components(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("document.doc_id", *[F.col(f"quality.{f}") for f in fields])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in ARRIVALS, dealt by doc_id; every document with the arrival it came in and the shard that holds it in the end."""
    docs = table(spark, sf_dir, "documents")
    arrival = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(ARRIVALS)).cast("int")
    store = ShardStore(spark, new_folder(spark, "shards"))
    store.append_each(docs, arrival, ARRIVALS, alone=True)
    store.vacuum()
    held = store.read()
    if held is None:
        return docs.select("doc_id", F.lit(0).alias("arrival"), F.lit(None).cast("string").alias("shard"), F.lit(0).cast("long").alias("version"))
    return held.select("doc_id", arrival.alias("arrival"), store.shard_of(held).alias("shard"), F.lit(store.version()).cast("long").alias("version"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sanitiser(table(spark, sf_dir, "documents")).spans()


OPERATORS = (
    op1_ann, op2_lm_scoring, op3_url_filter, op4_best_fit_packing, op5_simhash_near_dedup,
    op6_html_extraction, op7_mixing, op8_quality_rules, op9_sharding, op10_pii,
)  # fmt: skip


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


#: Runs of word characters, as the operators define them.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op3_url_filter": rf"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for v, r in RULES)}),
fits AS (
  SELECT s.page_id, s.host, s.path, r.rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id, s.host, s.path ORDER BY length(r.rule) DESC) AS nth
  FROM (SELECT DISTINCT * FROM split) s JOIN rules r
    ON (s.host = split_part(r.rule, '/', 1) OR ends_with(s.host, '.' || split_part(r.rule, '/', 1)))
   AND starts_with(s.path, substr(r.rule, strpos(r.rule, '/')))),
words AS (SELECT unnest({list(BLOCKED_WORDS)}) AS word),
blocked(host) AS (SELECT a.word || '-' || b.word || '.' || zone FROM words a, words b, (SELECT unnest({list(BLOCKED_ZONES)}) AS zone) z WHERE a.word <> b.word)
SELECT s.page_id, s.host, s.path, f.rule,
       coalesce(f.verdict, CASE WHEN EXISTS (SELECT 1 FROM blocked b WHERE s.host = b.host OR ends_with(s.host, '.' || b.host)) THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND f.host = s.host AND f.path = s.path AND f.nth = 1
""",
    "op7_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS dealt
  FROM documents),
sources AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY skey),
weighted AS (
  SELECT skey, source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1] AS DOUBLE) AS weight, 2 * source_size AS cap,
         least(1.5 * CAST(sum(source_size) OVER () AS DOUBLE), CAST(sum(2 * source_size) OVER () AS DOUBLE)) AS budget
  FROM sources),
levels AS (
  SELECT *, cap / weight AS ratio,
         (budget - CAST(sum(cap) OVER (ORDER BY cap / weight, skey) - cap AS DOUBLE)) / (sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, skey) + weight) AS level
  FROM weighted),
water AS (SELECT arg_min(level, (ratio, skey)) AS water FROM levels WHERE level < ratio),
targets AS (
  SELECT skey, source_size, budget, CASE WHEN water IS NULL OR ratio <= water THEN CAST(cap AS DOUBLE) ELSE water * weight END AS target
  FROM levels LEFT JOIN water ON true),
copies AS (
  SELECT s.skey, s.dealt, s.size, e.epoch, t.budget,
         (sum(s.size) OVER (PARTITION BY s.skey, e.epoch ORDER BY s.dealt) + e.epoch * t.source_size) / t.target AS finish
  FROM sized s JOIN targets t USING (skey), (VALUES (0), (1)) e(epoch)
  WHERE s.size > 0 AND t.target > 0),
summed AS (SELECT *, sum(size) OVER (ORDER BY finish, skey, dealt, epoch) AS total FROM copies),
chosen AS (SELECT skey, dealt, count(DISTINCT epoch) AS epochs FROM summed WHERE total <= budget GROUP BY skey, dealt)
SELECT s.doc_id, s.source, CAST(s.size AS BIGINT) AS size, t.source_size, t.target, CAST(CASE WHEN s.size > 0 THEN s.size * coalesce(c.epochs, 0) ELSE 0 END AS BIGINT) AS taken
FROM sized s JOIN targets t USING (skey) LEFT JOIN chosen c ON c.skey = s.skey AND c.dealt = s.dealt
""",
}


ORACLES["op8_quality_rules"] = rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
words AS (SELECT rid, unnest(range(1, len(words) + 1)) AS pos, length(unnest(words)) AS chars FROM texts),
windows AS (
  {" UNION ALL ".join(f"SELECT rid, {n} AS n, pos, array_to_string(words[pos:pos + {n - 1}], ' ') AS w FROM (SELECT rid, words, unnest(range(1, len(words) - {n - 2})) AS pos FROM texts WHERE len(words) > {n})" for n in sorted({*quality.MAX_DUPLICATED, quality.WINDOW}))}),
covered AS (
  SELECT DISTINCT rid, n, unnest(range(pos, pos + n)) AS pos
  FROM (SELECT *, count(*) OVER (PARTITION BY rid, n, w) AS often FROM windows) WHERE often > 1),
ngrams AS (SELECT rid, n, count(*) AS n_words, CAST(sum(chars) AS DOUBLE) AS chars FROM covered JOIN words USING (rid, pos) GROUP BY rid, n),
lines AS (SELECT rid, line, count(*) - 1 AS again, length(regexp_replace(line, '[ 	-]', '', 'g')) AS chars
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^ 	-]') GROUP BY rid, line),
repeats AS (SELECT rid, sum(again) AS again, CAST(sum(again * chars) AS DOUBLE) AS chars FROM lines GROUP BY rid),
counted AS (
  SELECT t.rid, t.doc_id, len(t.words) AS n_words, length(regexp_replace(t.text, '[ 	-]', '', 'g')) AS word_chars, len(regexp_extract_all(t.text, '[#*$%&|<>]')) AS n_symbols,
         CAST(coalesce(r.again, 0) AS BIGINT) AS n_dup_lines, coalesce(r.chars, 0) AS line_chars, coalesce(g.n_words, 0) AS n_repeat_words
  FROM texts t LEFT JOIN repeats r USING (rid) LEFT JOIN ngrams g ON g.rid = t.rid AND g.n = {quality.WINDOW}),
limits(n, most) AS (VALUES {", ".join(f"({n}, CAST({x} AS DOUBLE))" for n, x in quality.MAX_DUPLICATED.items())}),
over AS (SELECT DISTINCT c.rid FROM counted c JOIN ngrams g USING (rid) JOIN limits l ON l.n = g.n WHERE g.chars / greatest(c.word_chars, 1) > l.most),
base AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_PERCENT} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND line_chars / greatest(word_chars, 1) <= {quality.MAX_LINES} AND rid NOT IN (SELECT rid FROM over) AS kept
FROM base
"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
