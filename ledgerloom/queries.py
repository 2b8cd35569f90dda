"""Queries by name: each applies an operator of the library to the test tables. Columns are those of oracles.ORACLES."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import col as c
from pyspark.sql.functions import lit

from . import fixtures, oracles
from .config import Request
from .functions import phones, text, urls
from .operators import cache, contacts, metrics, page_evidence, planning, qualify, resolve, serve, storage
from .operators.graph import connected_components, cut
from .plans import persist, search
from .sources import geocode, osm, paging, places, web
from .sources.base import Capabilities

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.observations(spark, sf_dir)


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(resolve.normalised(resolve.stripped(observed(spark, sf_dir))))


# --- text, phones, URLs


@query
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(c("text")).alias("text_norm"))


@query
def norm_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(text.normalize_text(c("text"))).alias("fp"))


@query
def company_name_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).select("obs_id", text.company_name(c("name")).alias("name_norm"), text.identity_text(c("name")).alias("name_identity"), text.state_code(c("state")).alias("state_code"), text.tax_id(c("cnpj")).alias("tax_id"))


@query
def phone_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = phones.parse_phone(c("phone"))
    return observed(spark, sf_dir).select("obs_id", p["digits"].alias("phone"), p["kind"].alias("kind"), phones.normalize_phone(c("whatsapp")).alias("whatsapp"))


@query
def phone_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(phones.extract_phones(c("text")), ",").alias("numbers"))


@query
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.sanitize(c("text")).alias("clean"))


@query
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(c("url")).alias("url_norm")).withColumn("host", urls.host_of(c("url_norm")))


@query
def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.website_identity(c("url")).alias("identity"), urls.website_exact(c("url")).alias("exact"), urls.public_url(c("url")).alias("public"))


@query
def url_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    plain, end = F.regexp_extract("url", "^([^#]*)", 1), F.regexp_extract("url", "(#.*)?$", 1)
    u = F.concat(plain, F.when(F.contains(plain, lit("?")), "&").otherwise("?"), lit("token="), c("page_id"), lit("&lang=pt&Api-Key=x&page="), c("page_id") % 7, end)
    return rows.select("page_id", urls.export_url(u).alias("export_url"))


# --- resolution


@query
def block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.block_keys(rows_of(spark, sf_dir)).groupBy("reason").agg(F.count(lit(1)).alias("n"), F.countDistinct("key").alias("keys"))


@query
def block_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.edges_of(rows_of(spark, sf_dir)).groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


@query
def host_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.host_pairs(rows_of(spark, sf_dir))


@query
def clusters_unconstrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir)
    found = connected_components(resolve.edges_of(rows))
    return rows.select("obs_id").join(found.withColumnRenamed("node", "obs_id"), "obs_id", "left").select("obs_id", F.coalesce("root", "obs_id").alias("root"))


@query
def clusters_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir)
    return resolve.clusters(rows, cut(resolve.edges_of(rows)))[0]


@query
def match_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(observed(spark, sf_dir)).where(F.size("match_reasons") > 0).select("cluster", F.array_join("match_reasons", ",").alias("match_reasons"))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir)
    return resolve.selected_fields(resolve.field_values(rows.join(resolve.clusters(rows, cut(resolve.edges_of(rows)))[0], "obs_id")))


@query
def field_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir).select("cluster", "field", "canonical", "value", F.size("support").alias("support"))


@query
def field_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir).select("cluster", "field", F.array_join("alternatives", "|").alias("alternatives"))


@query
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(observed(spark, sf_dir)).select("cluster", "confidence", "confidence_level", "candidate_count")


@query
def resolved_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["rank", "cluster", "name", "phone", "whatsapp", "address", "city", "state", "category", "website", "cnpj", "confidence", "confidence_level"]
    return resolve.ranked(resolve.resolve(observed(spark, sf_dir))).select(*names)


@query
def source_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.contribution(resolve.resolve(observed(spark, sf_dir)))


@query
def near_exact_doc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = table(spark, sf_dir, "documents").select("doc_id", "source", c("source").alias("provider"), text.fingerprint(text.normalize_text(c("text"))).alias("external_id"), lit(None).cast("string").alias("source_url"), *[lit(None).cast("string").alias(x) for x in ("name", "phone", "address")])
    return metrics.first_seen(leads, [c("doc_id")]).select("doc_id", "source")


# --- planning and qualification


@query
def query_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[lit(x) for x in ("imobiliária em São Paulo", "dentistas no Rio de Janeiro", "padaria artesanal em Recife", "contador", "oficina mecânica na Bahia")])
    asked = table(spark, sf_dir, "nation").select("n_nationkey", F.get(kinds, c("n_nationkey") % 5).alias("query"), lit(None).cast("string").alias("category"), lit(None).cast("string").alias("location"))
    return planning.query_variations(asked).select("n_nationkey", "category", "location", "position", "variation")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pick(values: tuple, n: int):
        return F.get(F.array(*[lit(v) for v in values]), (c("p_partkey") % n).cast("int"))

    requested = ("Restaurante italiano", "Clínica odontológica", "Serviços contábeis", "Oficina mecânica", "Padarias e doces", "Dentistas")
    category = ("Restaurantes", "Odontologia estética", "Contabilidade", "Mecânica automotiva", "Doces", "Restaurante italiano", None)
    name = ("Padaria e Doces Silva", "Contabilidade Souza", "Clínica Sorriso", "Restaurante Italiano do Zé", "Auto Mecânica")
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), pick(requested, 6).alias("requested"), pick(category, 7).alias("category"), pick(name, 5).alias("name"))


@query
def token_coverage_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = {x: lit(None).cast("string") for x in ("address", "city", "state")}
    rows = categories(spark, sf_dir).withColumns(none | {"source_texts": F.array().cast("array<string>")})
    return qualify.deterministic(qualify.with_context(rows)).select("id", c("category_match").cast("string").alias("category_match"), "qualification_confidence")


@query
def category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = tuple((t, terms[0]) for triggers, terms in planning.SEMANTIC_CATEGORIES for t in triggers)
    return planning.first_match(categories(spark, sf_dir), c("requested"), stems, "concept").select("id", "concept")


@query
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories(spark, sf_dir).select("id", text.shares_long_token(c("requested"), F.coalesce("category", "name")).alias("shares"))


# --- metrics and states


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    nth = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id"))
    return e.select(c("event_type").alias("provider"), (c("user_id") % 4).cast("int").alias("variation"), (c("event_id") % 11 == 0).alias("rejected"), (nth > 1).alias("duplicate"), (c("user_id") % 10).alias("page"))


@query
def discovery_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.discovery(discovered(spark, sf_dir))


@query
def discovery_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.discovery(discovered(spark, sf_dir), with_totals=True).withColumn("variation", c("variation").cast("string"))


@query
def search_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return metrics.outcome(e.select(c("user_id").alias("search_id"), c("event_type").alias("provider"), (c("event_id") % 3 != 0).alias("succeeded"), (c("event_id") % 13 == 0).alias("limit_reached"), F.when(c("event_id") % 3 == 0, F.concat(lit("timeout "), c("event_id") % 5)).alias("error")))


@query
def status_rollforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = F.array(*[lit(x) for x in list(metrics.PROGRESS)[:6]])
    e = table(spark, sf_dir, "events")
    return metrics.latest_state(e.select(c("user_id").alias("search_id"), "ts", "event_id", F.get(stages, (c("event_id") % 6).cast("int")).alias("stage"), F.when(c("event_id") % 10 == 0, "completed").otherwise("running").alias("status")))


@query
def crash_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    searches = e.groupBy(c("user_id").alias("search_id")).agg(F.when(F.max("event_id") % 2 == 0, "running").otherwise("completed").alias("status"), lit(None).cast("string").alias("error_message"))
    return metrics.recovered(searches, e.where(c("event_id") % 50 == 0).select(c("user_id").alias("search_id"))).select("search_id", "status", "error_message")


@query
def cache_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", c("event_id").cast("string").alias("key"), c("ts").alias("last_access"), F.length("props").cast("long").alias("bytes"))
    return storage.within_budget(e, 100, 800, ["event_type"]).select("event_type", "key")


@query
def ttl_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(c("user_id").alias("key"), "ts", c("props").alias("payload"))
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    return metrics.fresh(e, now, 7 * 86_400).select("key", "ts")


@query
def request_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(c("event_id").alias("request_id"), c("event_type").alias("host"), c("ts").cast("timestamp").alias("ts"))
    return metrics.request_gaps(e, 60.0).select("request_id", "host")


@query
def provider_runs_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(c("event_type").alias("provider"), c("user_id").alias("search_id"))
    known = spark.createDataFrame([("click", "Clicks"), ("view", "Views"), ("purchase", "Purchases")], "provider string, display_name string")
    return metrics.with_sources_known(runs, known).groupBy("provider", "display_name").agg(F.count(lit(1)).alias("runs"))


@query
def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "events").select(c("event_type").alias("provider")).distinct()
    return metrics.missing_sources(wanted, spark.createDataFrame([("click",), ("view",)], "provider string"))


# --- storage


def results_and_stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def strings(df: DataFrame) -> DataFrame:
        return df.withColumns({n: c(n).cast("string") for n, t in df.dtypes if t.startswith("varchar")})

    return strings(fixtures.sql(spark, fixtures.RESULTS, sf_dir)), strings(fixtures.sql(spark, fixtures.STORED, sf_dir))


@query
def best_match_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = storage.match_scores(*results_and_stored(spark, sf_dir))
    return scores.groupBy("rank").agg(F.max(F.struct("score", "company_id")).alias("b")).select("rank", "b.company_id", "b.score")


@query
def assigned_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.assign(storage.match_scores(*results_and_stored(spark, sf_dir)))


@query
def upsert_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = results_and_stored(spark, sf_dir)
    extra = {x: lit(None).cast("string") for x in ("category", "instagram")}
    r = r.withColumns(extra | {"status": F.when(c("rank") % 4 == 1, "confirmed").when(c("rank") % 4 == 2, "unconfirmed").otherwise("not_found"), "whatsapp": lit("5511988887777")})
    s = s.withColumns(extra | {"status": c("whatsapp_status")})
    left = s.select("company_id", *[c(x).alias(f"s_{x}") for x in s.columns if x != "company_id"])
    right = r.select((c("rank") + 2).alias("company_id"), *[c(x).alias(f"r_{x}") for x in r.columns if x != "rank"])
    return storage.enriched(left.join(right, "company_id")).select("company_id", "phone", "address", "city", "state", "cnpj", "website", "whatsapp", "whatsapp_status", "confidence")


@query
def new_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.new_companies(results_and_stored(spark, sf_dir)[0]).select("rank", "normalized_name", "name_fingerprint", "website", "whatsapp_status")


@query
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.violations(results_and_stored(spark, sf_dir)[1].withColumn("confidence", c("confidence") + 5))


# --- serving


@query
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.when(c("o_orderkey") % 3 != 0, c("o_custkey").cast("int")).alias("rank"), c("o_orderdate").alias("created_at"), c("o_orderkey").alias("result_id"))
    return serve.page(o, 50, 100)


@query
def result_page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(c("o_custkey").cast("int").alias("rank"), c("o_orderdate").alias("created_at"), c("o_orderkey").alias("result_id"))
    return serve.page_json(o, 50, 0)


@query
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = resolve.ranked(resolve.resolve(observed(spark, sf_dir)))
    rows = res.withColumns({
        "company_id": c("cluster"), "result_id": c("cluster"), "search_id": lit(1), "whatsapp_status": F.when(c("whatsapp").isNull(), "not_found").otherwise("unconfirmed"), "category_match": lit(None).cast("boolean"),
        "qualification_confidence": lit(25), "qualification_method": lit("deterministic"), "qualification_reason": lit(None).cast("string"), "collected_at": lit("2026-01-01 00:00:00").cast("timestamp"),
        "sources": F.transform("sources", lambda s: F.struct(F.initcap(s["provider"]).alias("display_name"), s["provider"].alias("provider"), s["source_url"].alias("source_url"))),
        "evidence": F.when(c("whatsapp").isNotNull(), F.array(*[
            F.struct(lit("whatsapp").alias("contact_type"), lit(kind).alias("evidence_type"), lit(by).alias("source_provider"), F.concat(lit("https://a.example.com/?token=x&n="), c("whatsapp")).alias("source_url"), c("whatsapp").alias("normalized_value"), lit(official).alias("official_source"), lit(said).alias("excerpt"))
            for kind, by, official, said in (("claimed_number", "tavily", False, ""), ("explicit_label", "official_website", True, "WhatsApp"))
        ])),
    })
    return serve.export_rows(rows)


# --- sources


@query
def place_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kinds = F.array(*[lit(x) for x in ("real_estate_agent", "real_estate_service", "restaurant", "property_management")])
    x, y = c("p_partkey") % 360 - 180.0, c("p_partkey") % 170 - 85.0
    none = lambda t: lit(None).cast(t)
    rows = p.select(
        c("p_partkey").cast("string").alias("id"), F.struct(F.concat(lit("Imóveis "), "p_name").alias("primary")).alias("names"), none("string").alias("basic_category"),
        F.struct(F.get(kinds, (c("p_partkey") % 4).cast("int")).alias("primary"), none("array<string>").alias("hierarchy"), none("array<string>").alias("alternates")).alias("taxonomy"), none("struct<primary:string,alternate:array<string>>").alias("categories"),
        F.when(c("p_partkey") % 5 != 0, c("p_size") / 50.0).alias("confidence"), F.when(c("p_partkey") % 11 == 0, "permanently_closed").alias("operating_status"), none("array<string>").alias("websites"), none("array<string>").alias("socials"),
        none("array<string>").alias("phones"), none("array<struct<freeform:string,locality:string,region:string,country:string>>").alias("addresses"), none("array<struct<dataset:string,license:string,update_time:string>>").alias("sources"),
        F.struct(x.alias("xmin"), (x + 1).alias("xmax"), y.alias("ymin"), (y + 1).alias("ymax")).alias("bbox"),
    )
    return places.place_leads(rows, places.CATEGORIES[0], (-60.0, -40.0, 20.0, 30.0), min_confidence=0.5).select("external_id", "name", "category")


@query
def osm_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    tags = F.map_from_arrays(F.array(lit("name"), lit("office"), lit("contact:phone"), lit("website"), lit("ref:vatin")), F.array(c("s_name"), lit("accountant"), F.concat(lit("+55 11 3"), F.lpad(c("s_suppkey").cast("string"), 7, "0"), lit(";x")), F.concat(lit("site"), "s_suppkey", lit(".example.com")), F.concat(lit("BR"), F.lpad(c("s_suppkey").cast("string"), 14, "0"))))
    rows = s.select(F.when(c("s_suppkey") % 9 == 0, "area").otherwise("node").alias("type"), (c("s_suppkey") % 50 + 1).alias("id"), lit(0.0).alias("lat"), lit(0.0).alias("lon"), lit(None).cast("struct<lat:double,lon:double>").alias("center"), tags.alias("tags"), c("s_suppkey").alias("seq"))
    return osm.element_leads(rows.where(osm.selected("Contabilidade")), "Contabilidade").select("external_id", "name", "phone", "website", "cnpj", "source_url")


@query
def web_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer")
    title = F.when(c("c_custkey") % 4 == 0, F.concat(lit("10 melhores imobiliárias de "), "c_custkey")).otherwise(F.concat(lit("Imobiliária "), "c_name", lit(" | São Paulo")))
    rows = n.select(title.alias("title"), F.concat(lit("https://site"), "c_custkey", lit(".example.com/")).alias("url"), F.concat(lit("Imóveis em São Paulo. WhatsApp: (11) 9"), F.lpad(c("c_custkey").cast("string"), 8, "7")).alias("content"), c("c_acctbal").alias("score"))
    return web.result_leads(rows, Request(category="imobiliárias", location="São Paulo")).select("external_id", "name", "phone", "whatsapp", "city", "category", "website")


# --- pages and contacts


@query
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_evidence.visible_text(table(spark, sf_dir, "pages"))


@query
def html_links_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("s_suppkey")
    link = lambda href, label, more="": F.concat(lit(f'<a {more} href="{href}">'), label, lit("</a>"))
    body = F.concat(
        link("/sobre", lit("Sobre")), F.when(k % 2 == 0, link("/fale-conosco", lit("Escreva"))).otherwise(link("/a", lit("Contato"))), link("/contato.pdf", lit("contato")),
        link("https://other.example.org/contato", lit("contato")), link("/contato", lit("contato"), 'rel="nofollow"'), F.when(k % 3 == 0, link("/x", lit("<img alt='Nossas unidades'>"))).otherwise(link("/blog", lit("Blog"))),
    )
    pages = table(spark, sf_dir, "supplier").select(k.alias("page_id"), F.concat(lit("https://site"), k, lit(".example.com/")).alias("url"), body.alias("html"))
    return page_evidence.ranked_contact_links(page_evidence.page_links(pages)).select("page_id", "target", c("rank").cast("int").alias("rank"), "place")


@query
def html_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey")
    number = lambda d: F.concat(lit("9"), F.lpad(k.cast("string"), 8, d))
    body = (
        F.when(k % 4 == 0, F.concat(lit('<p>Loja</p><a href="tel:+5511'), number("7"), lit('">Ligue</a>')))
        .when(k % 4 == 1, F.concat(lit('<a href="https://wa.me/5511'), number("8"), lit('">Fale</a>')))
        .when(k % 4 == 2, F.concat(lit("<address>Rua das Flores, "), k, lit("</address>")))
        .otherwise(F.concat(lit('<a href="https://instagram.com/loja'), k, lit('/">Siga</a>')))
    )
    pages = table(spark, sf_dir, "customer").select(k.alias("page_id"), F.concat(lit("https://site"), k, lit(".example.com/")).alias("url"), F.concat(lit("<html><body>"), body, lit("</body></html>")).alias("html"))
    return page_evidence.page_evidence(pages).select("page_id", "field", "value", "evidence_type")


@query
def site_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(lit("https://site"), "s_suppkey", lit(".example.com")).alias("base"), "s_suppkey")
    link = lambda path, label: F.concat(lit('<a href="'), "base", lit(f'{path}">{label}</a>'))
    kinds = (("", F.concat(link("/sobre", "Sobre"), link("/contato", "Contato"))), ("/contato", link("/unidades", "Unidades")), ("/sobre", lit("")), ("/unidades", lit("")))
    pages = None
    for i, (path, body) in enumerate(kinds):
        part = s.select((c("s_suppkey") * 10 + i).alias("page_id"), F.concat("base", lit(path)).alias("url"), body.alias("html"))
        pages = part if pages is None else pages.union(part)
    return page_evidence.crawl(pages, s.select(c("base").alias("start")), 3)


@query
def contact_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey")
    kinds = F.array(*[lit(x) for x in ("direct_link", "structured_field", "explicit_label", "claimed_number", "generic_phone")])
    number = F.concat(lit("9"), F.lpad(k.cast("string"), 8, "5"))
    # on a local page a link would prove itself by its own URL; the plain number there doesn't
    value = F.when((k % 5 == 0) & (k % 7 != 0), F.concat(lit("https://wa.me/5511"), number)).otherwise(F.concat(lit("(11) "), number))
    rows = table(spark, sf_dir, "customer")
    evidence = rows.select(
        k.alias("company_id"), value.alias("value"), F.get(kinds, (k % 5).cast("int")).alias("evidence_type"),
        F.when(k % 7 == 0, "http://localhost/x").otherwise(F.concat(lit("https://site"), k, lit(".example.com/contato"))).alias("source_url"), lit("site").alias("source"), (k % 3 != 0).alias("official_source"),
        F.concat(lit("WhatsApp: (11) "), number).alias("context"), lit("WhatsApp").alias("field_name"),
    )
    companies = rows.select(k.alias("company_id"), F.concat(lit("(11) 9"), F.lpad((k * 7 % 1000).cast("string"), 8, "6")).alias("phone"))
    return contacts.decisions(companies, evidence).select("company_id", "phone", "whatsapp", "status")


@query
def nearest_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("s_suppkey")
    number = lambda d: F.concat(lit("(11) 9"), F.lpad(k.cast("string"), 8, d))
    t = F.concat(lit("Fixo "), number("7"), lit(" WhatsApp "), number("8"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", contacts.nearest_phone(t, F.instr(t, "WhatsApp") - 1).alias("number"))


@query
def search_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    class Observed:
        name, capabilities = "observed", Capabilities()

        def read(self, spark: SparkSession, request: Request) -> DataFrame:
            return observed(spark, sf_dir)

    ranked = search.run(spark, Request(category="Restaurante", location="São Paulo"), [Observed()])
    return ranked.select("rank", "cluster", "name", "phone", "whatsapp", "whatsapp_status", "confidence", "category_match", "qualification_confidence", "qualification_reason")


# --- predicates, batches and tables of a search


@query
def valid_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve.stripped(observed(spark, sf_dir)).withColumn("whatsapp_confirmed", c("obs_id") % 7 == 3)
    return rows.select("obs_id", resolve.valid_confirmation(rows).alias("valid")).select("obs_id", c("valid").cast("int").alias("valid"))


@query
def tax_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.tax_id_checked(F.lpad((c("o_orderkey") * 7919).cast("string"), 14, "0")).alias("tax_id"))


@query
def presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    phone = F.concat(lit("55119"), F.lpad(c("c_custkey").cast("string"), 8, "7"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.display_phone(phone).alias("phone"), text.display_confidence((c("c_custkey") % 250 - 50).cast("double")).alias("confidence"), text.display_location(F.when(c("c_custkey") % 2 == 0, c("c_name")), lit("SP")).alias("location"), text.safe_cell(F.concat(F.when(c("c_custkey") % 3 == 0, "=").otherwise(""), "c_name")).alias("cell"))


@query
def classifier_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), c("c_nationkey").alias("search_id"))
    return planning.chunks(rows, [c("id")], 4, 10, ["search_id"])


@query
def search_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey")
    rows = table(spark, sf_dir, "customer").select(c("c_nationkey").alias("search_id"), F.when(k % 3 == 0, "n").alias("whatsapp"), F.when(k % 6 == 0, "confirmed").otherwise("not_found").alias("whatsapp_status"), (k % 4 == 0).alias("enriched"), F.when(k % 5 == 0, "model").otherwise("deterministic").alias("qualification_method"))
    return metrics.counters(rows)


@query
def enrichment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("company_id"), (k % 3 != 0).alias("attempted"), F.when(k % 5 == 1, "timeout").alias("error"))
    return metrics.enrichment_counters(rows, 50).withColumn("errors", F.array_join("errors", "|")).withColumn("limit_reached", c("limit_reached").cast("int"))


@query
def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    denied = pages.select(urls.website_host(c("url")).alias("host")).distinct().where(F.length("host") % 3 == 0).select("host", lit("/en/").alias("path"))
    return web.allowed_by_robots(web.fetchable(pages), denied).select("page_id")


@query
def official_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("s_suppkey")
    none = F.array().cast("array<struct<provider:string,data:string>>")
    rows = table(spark, sf_dir, "supplier").select(k.alias("cluster"), F.when(k % 2 == 0, "Padaria Aurora").otherwise("Loja 24").alias("name"), F.when(k % 3 == 0, "https://www.facebook.com/aurora").otherwise(F.concat(lit("https://www.aurora-"), k, lit(".example.com"))).alias("website"), none.alias("sources"))
    return search.attributed(rows).select("cluster")


@query
def preferred_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("s_suppkey")
    kinds = ("visible_text", "meta_tag", "structured_data", "meta_tag")
    rows = table(spark, sf_dir, "supplier").select(k.alias("page_id"), F.posexplode(F.array(*[F.struct(lit(x).alias("evidence_type"), F.concat(lit(str(i)), k).alias("value")) for i, x in enumerate(kinds)])).alias("seq", "e"))
    rows = rows.where((c("page_id") % 2 == 0) | (c("e.evidence_type") != "structured_data")).select("page_id", "seq", lit("phone").alias("field"), "e.value", "e.evidence_type", F.when(c("seq") == 3, "https://x.example.com/contato").otherwise("https://x.example.com/").alias("url"))
    return contacts.preferred_phone(rows)


def persisted(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    r, s = results_and_stored(spark, sf_dir)
    none = {x: lit(None).cast("string") for x in ("category", "instagram")}
    source = F.array(F.struct(lit("registry").alias("provider"), lit("https://registry.example.org/").alias("source_url"), c("rank").cast("string").alias("external_id")))
    return persist.plan(r.withColumns(none | {"whatsapp_status": lit("not_found"), "sources": source}), s.withColumns(none), 1)


@query
def persist_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persisted(spark, sf_dir)["search_results"].select("rank", "confidence")


@query
def persist_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persisted(spark, sf_dir)["companies"].agg(F.count(lit(1)).alias("companies"), F.count("cnpj").alias("with_tax_id"))


@query
def contact_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey")
    number = F.concat(lit("9"), F.lpad(k.cast("string"), 8, "8"))
    spelt = F.when(k % 3 == 0, F.concat(lit("+55 (11) "), number)).when(k % 3 == 1, F.concat(lit("011"), number)).otherwise(F.concat(lit("21"), number))
    full = F.concat(lit("5511"), number)
    title, tag = F.when(k % 4 == 0, F.concat(lit("Fale: (11) "), number)).otherwise("Fale"), F.when(k % 4 == 1, F.concat(lit("11 "), number)).when(k % 4 == 2, "none")
    refs = F.when(k % 5 == 0, F.array(lit("Q1"))).when(k % 5 == 1, F.array(lit("C1"))).when(k % 5 == 2, F.array(lit("Q1"), lit("S9"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", phones.equivalent(full, spelt).cast("int").alias("same_number"), contacts.source_supports(full, title, lit(None).cast("string"), tag).cast("int").alias("supported"),
        text.joined_reasons(F.when(k % 2 == 0, "even"), F.when(k % 3 == 0, "third")).alias("reasons"), qualify.refs_valid(refs, F.array(lit("Q1"), lit("C1")), k % 2 == 0).cast("int").alias("refs_valid"),
    )


@query
def first_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seen = e.select((c("user_id") % 40).alias("page_id"), lit("phone").alias("field"), c("event_type").alias("value"), lit("tel_link").alias("evidence_type"), (c("event_id") % 2).cast("string").alias("url"), c("event_id").alias("seq"))
    return contacts.first_evidence(seen).select("page_id", "value", "url", "seq")


# --- answers of sources


def paged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as leads on pages of four variations; page 3 ends a variation, page 5 repeats the cursor of page 1 in one."""
    e = table(spark, sf_dir, "events")
    leads = e.select(c("event_type").alias("provider"), (c("user_id") % 4).cast("int").alias("variation"), (c("event_id") % 7).cast("int").alias("page"), c("event_id").alias("position"), (c("user_id") * 8 + c("event_id") % 8).cast("string").alias("external_id"), *[lit(None).cast("string").alias(x) for x in ("source_url", "name", "phone", "address")])
    cursor = F.when((c("variation") == 0) & (c("page") == 3), lit(None)).when((c("variation") == 1) & (c("page") == 2), lit("c1")).otherwise(F.concat(lit("c"), c("page")))
    pages = leads.groupBy("provider", "variation", "page").agg(F.count(lit(1)).alias("raw"), F.count_if(c("position") % 5 == 0).alias("rejected")).withColumn("next_cursor", cursor)
    return leads, pages


@query
def paged_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.collected(*paged(spark, sf_dir), 6, 300).where(~c("duplicate")).select("provider", "variation", "page", "position", c("limit_reached").cast("int").alias("limit_reached"))


@query
def paged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.variation_metrics(*paged(spark, sf_dir), 6, 300).withColumn("limit_reached", c("limit_reached").cast("int"))


@query
def geocode_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("n_nationkey").cast("double")
    box = F.array((k - 10).cast("string"), F.when(c("n_nationkey") % 5 == 0, k - 20).otherwise(k).cast("string"), lit("-46.5"), F.when(c("n_nationkey") % 7 == 0, lit("x")).otherwise(lit("-40")))
    address = F.create_map(lit("state"), lit(" SP "), F.when(c("n_nationkey") % 2 == 0, "town").otherwise("city"), c("n_name"))
    answers = table(spark, sf_dir, "nation").select(F.concat(lit("Á "), "n_name").alias("location"), F.array(F.struct(box.alias("boundingbox"), address.alias("address"), c("n_name").alias("display_name"))).alias("results"))
    asked = answers.select("location", geocode.geocode_query(F.when(F.length("location") % 2 == 0, F.concat("location", lit(", Brasil"))).otherwise(c("location"))).alias("query"))
    return geocode.located(asked, geocode.areas(answers)).select("location", "query", "south", "north", "west", "east", "city", "state")


@query
def robots_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    statuses = F.array(*[lit(x) for x in (200, 200, 403, 404, 429, 503, 200)])
    body = lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /en/1\nDisallow: /en/\nDisallow: /de\n")
    origins = pages.select(web.origin_of(c("url")).alias("origin")).where("origin is not null").distinct()
    robots = origins.where(F.length("origin") % 11 > 0).select("origin", F.get(statuses, F.length("origin") % 7).alias("status"), body.alias("body"))
    return web.robots_verdicts(pages, robots, "ledgerloom").select("page_id", "robots")


@query
def marker_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("s_suppkey")
    number = lambda d: F.concat(lit("9"), F.lpad(k.cast("string"), 8, d))
    body = (
        F.when(k % 4 == 0, F.concat(lit('<a href="https://wa.me/5511'), number("7"), lit('">Fale</a>')))
        .when(k % 4 == 1, F.concat(lit("<p>Fixo (11) 3456-7890. WhatsApp (11) "), number("8"), lit("</p>")))
        .when(k % 4 == 2, F.concat(lit("<p>Não temos WhatsApp (11) "), number("8"), lit("</p>")))
        .otherwise(F.concat(lit("<p>Veja https://api.whatsapp.com/send?phone=5511"), number("6"), lit(" e WhatsApp: (11) "), number("5"), lit("</p><script>WhatsApp (11) 91111-2222</script>")))
    )
    pages = table(spark, sf_dir, "supplier").select(k.alias("page_id"), F.when(k % 9 == 0, "http://localhost/").otherwise(F.concat(lit("https://site"), k, lit(".example.com/"))).alias("url"), body.alias("html"))
    return page_evidence.marker_evidence(pages, "site", c("page_id") % 2 == 0).select("page_id", "evidence_type", "number", c("official_source").cast("int").alias("official"))


@query
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey")
    said = F.when(k % 4 == 0, (k % 100).cast("string")).when(k % 4 == 1, F.concat(lit("Thu, 01 Jan 2026 00:"), F.lpad((k % 60).cast("string"), 2, "0"), lit(":00 GMT"))).when(k % 4 == 2, "soon")
    asked = cache.retry_after(said, lit("2026-01-01 00:00:30").cast("timestamp"))
    return table(spark, sf_dir, "customer").select("c_custkey", asked.alias("asked"), cache.backoff(k % 9, 0.5, 60.0, asked).alias("wait"))


@query
def redacted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), F.struct(
        c("c_name").alias("name"), lit("s3").alias("API_KEY"), F.array(F.struct(lit("x").alias("sessionToken"), c("c_custkey").alias("n"))).alias("calls"), F.create_map(lit("Authorization"), lit("Bearer"), lit("page"), c("c_name")).alias("headers"),
    ).alias("fields"))
    shown = metrics.redacted(c("fields"), rows.schema["fields"].dataType)
    return rows.select("id", shown.alias("f")).select("id", "f.name", c("f.API_KEY").alias("api_key"), c("f.calls")[0]["sessionToken"].alias("token"), c("f.calls")[0]["n"].alias("n"), c("f.headers")["Authorization"].alias("auth"), c("f.headers")["page"].alias("page"))


@query
def classifier_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("event_id")
    rows = table(spark, sf_dir, "events").select(k.alias("seq"), (k % 1000).alias("batch"), (k % 3 == 0).alias("cached"), F.when(k % 100 == 7, F.concat(lit("refused "), k % 4)).alias("diagnostic"))
    return metrics.classifier_counters(rows).withColumn("diagnostics", F.array_join("diagnostics", "|"))


@query
def hydrated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("o_orderkey")
    results = table(spark, sf_dir, "orders").select(k.alias("result_id"), c("o_custkey").alias("company_id"), (k % 100).cast("int").alias("rank"))
    companies = table(spark, sf_dir, "customer").select(c("c_custkey").alias("company_id"), c("c_name").alias("name"))
    lines = table(spark, sf_dir, "lineitem")
    sources = lines.select(c("l_orderkey").alias("result_id"), F.concat(lit("Source "), "l_linenumber").alias("display_name"), c("l_linenumber").cast("string").alias("provider"), lit(None).cast("string").alias("source_url"))
    evidence = lines.where("l_linenumber = 1").select(c("l_orderkey").alias("result_id"), *[lit(x).alias(n) for n, x in (("contact_type", "whatsapp"), ("evidence_type", "direct_link"), ("source_provider", "site"), ("source_url", "https://a.example.com/"), ("normalized_value", "5511"), ("official_source", True), ("excerpt", ""))])
    rows = serve.hydrated(results, companies, sources, evidence)
    return rows.select("result_id", "name", F.array_join(F.transform("sources", lambda s: s["provider"]), ",").alias("providers"), F.size(F.coalesce("evidence", F.array())).alias("evidence"))


@query
def persist_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _ = results_and_stored(spark, sf_dir)
    k = c("rank")
    number = F.concat(lit("55119"), F.lpad(k.cast("string"), 8, "8"))
    said = r.select("rank", F.when(k % 3 > 0, F.concat(lit("https://site"), k, lit(".example.com/"))).alias("url"), F.explode(F.array(lit("direct_link"), lit("explicit_label"), lit("direct_link"))).alias("evidence_type"), lit("site").alias("source"), number.alias("number"), (k % 2 == 0).alias("official_source"), lit("WhatsApp").alias("context"))
    phones_seen = r.select("rank", lit("phone").alias("field"), F.when(k % 2 == 0, c("phone")).otherwise(lit("551130001111")).alias("value"), lit("tel_link").alias("evidence_type"), lit("https://a.example.com/").alias("source_url"), lit("x").alias("excerpt"))
    results = r.select("rank", (k * 10).alias("result_id"), (k * 100).alias("company_id"))
    return persist.evidence_rows(results, r, said, phones_seen).select("result_id", "company_id", "contact_type", "evidence_type", c("official_source").cast("int").alias("official"))


@query
def finished_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    variations = paging.variation_metrics(*paged(spark, sf_dir), 6, 300)
    failed = spark.createDataFrame([("click", "timeout"), ("nowhere", "refused")], "provider string, error string")
    return metrics.run_rows(lit(7), variations, failed).select("search_id", "provider", "new", "pages", "variations", "status")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.ORACLES.items() if k in QUERIES}
