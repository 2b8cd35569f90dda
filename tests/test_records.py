"""Resolution, storage, contacts, pages, serving and streaming on small inputs."""

import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

import __spark_entry__
from ledgerloom import queries as record_queries
from ledgerloom.config import Request, Settings
from ledgerloom.operators import cache, contacts, metrics, page_evidence, planning, qualify, resolve, serve, storage
from ledgerloom.operators.graph import connected_components
from ledgerloom.plans import search
from ledgerloom.schemas import EVIDENCE, LEAD, OSM_ELEMENT
from ledgerloom.sources import base, osm, web
from ledgerloom.sources.base import Capabilities, as_leads
from ledgerloom.streaming import states

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def leads(spark, *items):
    names = [x.split()[0] for x in LEAD.split(", ")]
    filled = [{"obs_id": i, "provider": "a", "name": "X", "whatsapp_confirmed": False} | x for i, x in enumerate(items)]
    return spark.createDataFrame([tuple(x.get(n) for n in names) for x in filled], LEAD)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(record_queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    mine = record_queries.queries()[name](spark, SF)
    other = con.execute(record_queries.oracle_sql()[name])
    columns = [d[0] for d in other.description]
    assert sorted(mine.columns) == sorted(columns)
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else str(x) if hasattr(x, "isoformat") else x for x in r)
    assert sorted(map(plain, mine.select(*columns).collect()), key=repr) == sorted(map(plain, other.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_components_match_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {n: find(n) for n in root}


def test_two_tax_ids_never_merge(spark):
    phone = "(11) 99876-5432"
    got = resolve.resolve(leads(spark, {"cnpj": "1" * 14, "phone": phone}, {"cnpj": "2" * 14, "phone": phone, "name": "Y"}, {"phone": phone, "name": "Z"}))
    assert sorted((r.cnpj or "", r.candidate_count) for r in got.collect()) == [("", 1), ("1" * 14, 1), ("2" * 14, 1)]


def test_branches_stay_apart_and_values_are_chosen(spark):
    got = resolve.resolve(
        leads(spark, {"name": "Loja Boa", "city": "Recife", "address": "Rua A 1"}, {"name": "Loja Boa LTDA", "city": "Recife", "address": "Rua B 2", "provider": "b"}, {"name": "LOJA BOA", "city": "recife", "provider": "c"})
    )
    assert sorted((r.address or "", r.candidate_count) for r in got.collect()) == [("", 1), ("Rua A 1", 1), ("Rua B 2", 1)]
    same = resolve.resolve(leads(spark, {"name": "Loja Boa", "cnpj": "1" * 14, "source_url": "https://a.example.com"}, {"name": "Lója Boa", "cnpj": "1" * 14, "provider": "b"})).first()
    assert (same.name, same.candidate_count, same.match_reasons, same.confidence) == ("Lója Boa", 2, ["cnpj"], 10 + 22 + 5 + 30 + 8)


def test_name_that_normalises_to_nothing(spark):
    assert [r.name for r in resolve.resolve(leads(spark, {"name": " 漢字 "})).collect()] == ["漢字"]


def test_observations_may_be_empty(spark):
    assert resolve.ranked(resolve.resolve(leads(spark))).count() == 0


def test_assignment_is_that_of_ranks_in_turn(spark):
    rnd = random.Random(5)
    scores = {(rnd.randrange(30), rnd.randrange(25)): rnd.choice([20, 30, 50, 100]) for _ in range(120)}
    taken, want = set(), []
    for rank in sorted({r for r, _ in scores}):
        best = max(((s, c) for (r, c), s in scores.items() if r == rank and c not in taken), default=None)
        if best:
            taken.add(best[1])
            want.append((rank, best[1], best[0]))
    pairs = spark.createDataFrame([(r, c, s) for (r, c), s in scores.items()], "rank long, company_id long, score int")
    assert rows(storage.assign(pairs)) == rows(storage.assign(pairs, block_pairs=0)) == sorted(want, key=repr)
    assert rows(storage.assign(pairs.limit(0))) == []


def test_gaps_and_budgets_by_slots_of_time(spark):
    rnd = random.Random(9)
    asked = [(i, rnd.choice(["a", "a", "b", None]), None if i % 50 == 0 else 3600 * rnd.randrange(3) + rnd.randrange(3600) + rnd.choice([0.0, 0.5]), rnd.randrange(40)) for i in range(600)]
    df = spark.createDataFrame(asked, "request_id long, host string, at double, bytes long").withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    for least in (5.0, 9000.0):
        want, last = [], {}
        for i, host, at, _ in sorted((x for x in asked if x[2] is not None), key=lambda x: (x[2], x[0])):
            if host in last and at - last[host] < least:
                want.append((i, at - last[host]))
            last[host] = at
        assert rows(metrics.request_gaps(df, least).select("request_id", "gap")) == sorted(want, key=repr)
    for entries, size in ((7, 10**6), (10**6, 900), (200, 2500), (0, 10)):
        want = []
        for host in ("a", "b", None):
            used = 0
            for n, (i, _, _, b) in enumerate(sorted((x for x in asked if x[1] == host), key=lambda x: (x[2] is None, -(x[2] or 0), x[0])), 1):
                used += b
                if n <= entries and used <= size:
                    want.append((i,))
        got = storage.within_budget(df.withColumnsRenamed({"request_id": "key", "ts": "last_access"}), entries, size, ["host"])
        assert got.columns == ["key", "host", "at", "bytes", "last_access"] and rows(got.select("key")) == sorted(want, key=repr)


def test_contact_decisions(spark):
    page = "https://loja.example.com/contato"
    evidence = spark.createDataFrame(
        [
            (1, "11998765432", "explicit_label", page, "site", True, "WhatsApp: (11) 99876-5432", None), (1, "11998765433", "direct_link", page, "site", False, None, None),
            (2, "11998765432", "explicit_label", page, "site", True, "não temos WhatsApp (11) 99876-5432", None), (3, "11998765432", "generic_phone", page, "site", True, None, None),
            (4, "https://wa.me/5511998765432", "direct_link", None, "site", True, None, None),
        ], EVIDENCE,
    )
    companies = spark.createDataFrame([(i, None) for i in range(1, 6)], "company_id long, phone string")
    got = {r.company_id: (r.whatsapp, r.status, r.alternates) for r in contacts.decisions(companies, evidence).collect()}
    assert got == {1: ("5511998765432", "confirmed", ["5511998765433"]), 2: ("5511998765432", "unconfirmed", []), 3: (None, "not_found", []), 4: ("5511998765432", "confirmed", []), 5: (None, "not_found", [])}


def test_page_evidence(spark):
    page = """<html><body><p>CNPJ 04.252.011/0001-10</p><a href="https://wa.me/5511998765432">Fale</a><a href="tel:+551134567890">Ligue</a>
      <address>Rua das Flores, 10</address><script type="application/ld+json">{"@type": "LocalBusiness", "telephone": "(11) 3456-7891", "sameAs": ["https://instagram.com/loja"]}</script>
      <script>var x = {"whatsapp": "11 99876-5433"}</script><div data-phone="(11) 3456-7892">x</div><style>(11) 3456-7899</style></body></html>"""
    pages = spark.createDataFrame([(1, "https://loja.example.com/", page), (2, None, None), (3, "x", "")], "page_id long, url string, html string")
    got = {(r.field, r.value, r.evidence_type) for r in page_evidence.page_evidence(pages).collect()}
    assert got == {
        ("whatsapp", "5511998765432", "whatsapp_link"), ("phone", "551134567890", "tel_link"), ("address", "Rua das Flores, 10", "address_element"), ("phone", "551134567891", "structured_data"),
        ("instagram", "https://www.instagram.com/loja/", "structured_data"), ("whatsapp", "5511998765433", "explicit_whatsapp_label"), ("phone", "551134567892", "html_attribute"), ("cnpj", "04252011000110", "visible_text"),
    }


def test_contact_links(spark):
    page = '<a href="/sobre">Sobre</a><a href="/fale-conosco">x</a><a href="/a.pdf">contato</a><a href="https://other.example.org/contato">c</a><a rel="nofollow" href="/contato">c</a>'
    pages = spark.createDataFrame([(1, "https://loja.example.com/", page)], "page_id long, url string, html string")
    assert [(r.target, r["rank"]) for r in page_evidence.ranked_contact_links(page_evidence.page_links(pages)).orderBy("place").collect()] == [("https://loja.example.com/fale-conosco", 0), ("https://loja.example.com/sobre", 3)]


def test_qualification(spark):
    df = spark.createDataFrame(
        [("Dentistas", "Odontologia", "x"), ("Dentistas", "Restaurante", "x"), ("Padaria", None, "Padaria Silva"), (None, None, "x"), ("Padaria", None, "x"), ("Padaria fina", "Padaria", "x")], "requested string, category string, name string"
    ).withColumns({x: F.lit(None).cast("string") for x in ("address", "city", "state")} | {"source_texts": F.array().cast("array<string>")})
    got = [(r.category_match, r.qualification_confidence) for r in qualify.deterministic(qualify.with_context(df)).collect()]
    assert got == [(True, 96), (False, 95), (True, 82), (None, 100), (None, 25), (None, 25)]


def test_classifier_refs_are_checked(spark):
    import pandas as pd

    df = spark.createDataFrame([(1, "padaria", None, "Silva", []), (2, "padaria", None, "Souza", [])], "key long, q string, c string, n string, s array<string>")

    def answer(frame):
        return pd.DataFrame({"ref": frame["ref"], "category_match": True, "confidence": 70, "refs": [["Q1", "N1"] if n == "Silva" else ["Q1", "S9"] for n in frame["n"]]})

    assert [(r.key, r.category_match) for r in qualify.classify(df, answer).orderBy("key").collect()] == [(1, True), (2, None)]


def test_web_results(spark):
    df = spark.createDataFrame([("10 melhores imobiliárias", "https://a.example.com", "", 0.5), ("Casa Nova | Recife", "https://casa.example.com", "imobiliária em Recife wa.me/5581998765432", 0.9), ("x", "notaurl", "", None)], "title string, url string, content string, score double")
    got = web.result_leads(df, Request(category="imobiliárias", location="Recife")).collect()
    assert [(r.name, r.whatsapp, r.city, r.category) for r in got] == [("Casa Nova", "5581998765432", "Recife", "imobiliárias")]


def test_overpass_answers(spark, tmp_path):
    element = {"type": "node", "id": 7, "lat": -8.0, "lon": -34.9, "tags": {"name": "Conta Certa", "office": "accountant", "contact:whatsapp": "+55 81 99876-5432", "website": "contacerta.example.com;x"}}
    (tmp_path / "a.json").write_text(json.dumps({"elements": [element, element, {"type": "node", "id": 8, "tags": {"office": "accountant"}}]}))
    source = osm.OverpassSource(str(tmp_path), {"Recife": (-35.0, -8.2, -34.8, -7.9, "Recife", "PE")})
    base.register(source)
    got = source.read(spark, Request(category="contabilidade", location="Recife")).collect()
    assert [(r.name, r.whatsapp, r.whatsapp_confirmed, r.website, r.external_id) for r in got] == [("Conta Certa", "5581998765432", False, "https://contacerta.example.com", "osm:node:7")]
    assert tuple(osm.counts(osm.read_overpass(spark, str(tmp_path))).first()) == (3, 1)
    assert 'nwr["office"="accountant"](-8.2,-35.0,-7.9,-34.8);' in osm.overpass_query("Contabilidade", (-35.0, -8.2, -34.8, -7.9)) and "openstreetmap" in base.registered() and OSM_ELEMENT


def test_variations_and_requests(spark):
    asked = spark.createDataFrame([("dentistas em São Paulo", None, None)], "query string, category string, location string")
    assert [r.variation for r in planning.query_variations(asked, 2).collect()] == ["dentistas em São Paulo", "dentista em São Paulo"]
    with pytest.raises(ValueError):
        Request(category="x" * 3)
    with pytest.raises(ValueError):
        Settings(result_page=0)


def test_workbook_and_csv(spark, tmp_path):
    import zipfile

    df = spark.createDataFrame([(i, f"<{i}>") for i in range(5)], "n int, x string")
    serve.write_xlsx(df, str(tmp_path / "book.xlsx"), sheet_rows=2)
    book = zipfile.ZipFile(tmp_path / "book.xlsx")
    assert sum(n.startswith("xl/worksheets/") for n in book.namelist()) == 3 and b"&lt;4&gt;" in book.read("xl/worksheets/sheet3.xml")
    serve.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5
    with pytest.raises(ValueError):
        serve.require_terminal("running")


def test_log_fields_are_redacted(spark):
    got = spark.range(1).select(metrics.redacted(F.create_map(F.lit("api_key"), F.lit("x"), F.lit("step"), F.lit("y")), MapType(StringType(), StringType())).alias("m")).first().m
    assert got == {"api_key": "***", "step": "y"}


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "a", "2026-01-01 00:00:00", 1.0), (2, "a", "2026-01-01 00:00:10", 2.0), (3, "b", "2026-01-01 00:20:00", 4.0)], "event_id long, kind string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    once = states.run_available(states.distinct_within(stream(), ["kind"], "ts", "1 hour"), "once", str(tmp_path / "c1"))
    assert sorted(r.kind for r in once.collect()) == ["a", "b"]
    counts = states.run_available(states.windowed_counts(stream(), "ts", "10 minutes", "1 hour", "kind"), "counts", str(tmp_path / "c2"), "complete")
    assert sorted((r.kind, r.n, r.value) for r in counts.collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
    newest = states.run_available(states.latest(stream(), "kind", "ts", "1 hour", "event_id"), "newest", str(tmp_path / "c3"), "complete")
    assert sorted((r.kind, r.event_id) for r in newest.collect()) == [("a", 2), ("b", 3)]


def test_linked_data_and_attributes(spark):
    page = """<html><head><meta property="og:phone_number" name="telephone" content="(11) 3456-7890"></head><body><a href="/x" aria-label="Nosso WhatsApp" title="t"><img alt="logo">Fale</a>
      <span id="whatsapp-box" data-number="11 99876-5432"></span><noscript><a href="https://wa.me/5511911112222">x</a></noscript><script src="a.js">var whatsapp = 1</script>
      <script type="application/json+ld; charset=utf-8">[{"@type": ["Store"], "contactPhone": ["(11) 3456-7891"], "contact:whatsapp": "https://wa.me/5511998765433", "url": "https://instagram.com/loja",
        "location": {"@type": "PostalAddress", "streetAddress": "Rua A, 1", "addressRegion": "SP"}, "vatID": "04.252.011/0001-10"}]</script></body></html>"""
    pages = spark.createDataFrame([(1, "https://loja.example.com/", page)], "page_id long, url string, html string")
    got = {(r.field, r.value, r.evidence_type) for r in page_evidence.page_evidence(pages).collect()}
    assert got == {
        ("phone", "551134567890", "meta_tag"), ("whatsapp", "5511998765432", "explicit_whatsapp_label"), ("phone", "551134567891", "structured_data"), ("whatsapp", "5511998765433", "whatsapp_link"),
        ("instagram", "https://www.instagram.com/loja/", "structured_data"), ("address", "Rua A, 1, SP", "structured_data"), ("cnpj", "04252011000110", "structured_data"),
    }
    assert [(r.label) for r in page_evidence.page_links(pages).collect()] == ["Nosso WhatsApp t logo Fale"]


def test_a_cache_keeps_answers_for_a_time(spark, tmp_path):
    now = [100.0]
    kept = cache.TableCache(spark, str(tmp_path / "cache"), ttl_seconds=10, max_entries=2, clock=lambda: now[0])

    class Counted:
        name, reads = "counted", 0

        def read(self, spark, request):
            self.reads += 1
            return spark.createDataFrame([(self.reads,)], "n int")

    source, request = Counted(), Request(query="padarias em Recife")
    value = lambda: cache.remembered(kept, spark, source, request).first()["n"]
    assert [value(), value()] == [1, 1]
    now[0] = 111.0
    assert value() == 2 and kept.get("other") is None
    for i in range(3):
        now[0] += 1
        kept.set(f"k{i}", spark.createDataFrame([(i,)], "n int"))
    assert kept.get("k0") is None and [kept.get(f"k{i}").first()["n"] for i in (1, 2)] == [1, 2]
    assert kept.delete("k1") and not kept.delete("k1")
    kept.clear()
    assert kept.get("k2") is None


def test_a_search_with_pages_and_classifier(spark):
    class Two:
        name, capabilities = "registry", Capabilities(query_variations=True)
        asked = []

        def read(self, spark, request):
            self.asked.append(request.query)
            rows = [(1, "Padaria Aurora", "https://aurora.example.com", None), (2, "Casa Lima", "https://casalima.example.com", "(11) 3456-7890")]
            df = spark.createDataFrame(rows, "obs_id long, name string, website string, phone string").withColumn("external_id", F.col("obs_id").cast("string"))
            return as_leads(df.withColumns({"source_url": F.col("website"), "city": F.lit("Recife"), "data": F.create_map(F.lit("category_text"), F.lit("pães e doces"))}), "registry")

    pages = spark.createDataFrame(
        [(1, "https://aurora.example.com", '<a href="/contato">Contato</a>'), (2, "https://aurora.example.com/contato", '<a href="https://wa.me/5511998765432">Fale</a>'), (3, "https://aurora.example.com/far", '<a href="tel:+551134567899">x</a>')],
        "page_id long, url string, html string",
    )
    seen = []

    def classifier(batch):
        seen.append(batch)
        return batch.assign(category_match=True, confidence=90, refs=[["Q1", "N1"]] * len(batch))[["ref", "category_match", "confidence", "refs"]]

    source = Two()
    rows = {r.name: r for r in search.run(spark, Request(category="Restaurante", location="Recife"), [source], pages, Settings(enrichment_pages=2), classifier).collect()}
    assert len(source.asked) > 1 and source.asked[0].startswith("Restaurante")
    assert (rows["Padaria Aurora"].whatsapp, rows["Padaria Aurora"].whatsapp_status) == ("5511998765432", "confirmed") and rows["Padaria Aurora"].phone != "551134567899"
    assert all((r.category_match, r.qualification_confidence, r.qualification_method) == (True, 90, "model") for r in rows.values())
    without = search.run(spark, Request(category="Restaurante", location="Recife"), [source]).collect()
    assert {r.qualification_method for r in without} == {"deterministic"} and {r.category_match for r in without} == {None}


def shuffles(df):
    """The plan's lines that deal rows by a hash."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]


def test_ranks_are_sorted_by_columns(spark):
    plans = []
    kept, resolve.cut = resolve.cut, lambda df, ordered=False: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, ordered)
    try:
        one = spark.createDataFrame([(1, 9, "X", None, None, None, None), (2, 9, "Á", "Recife", "PE", None, None)], "cluster long, confidence int, name string, city string, state string, cnpj string, phone string")
        assert [(r.cluster, r["rank"]) for r in resolve.ranked(one).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    finally:
        resolve.cut = kept
    sort = next(x for x in plans[0].splitlines() if "Sort [" in x)
    assert "translate" not in sort and "regexp" not in sort


def test_observations_are_dealt_to_all_tasks(spark):
    assert any("obs_id" in x for x in shuffles(resolve.normalised(leads(spark, {}))))


def test_web_results_are_dealt_to_all_tasks(spark):
    df = spark.createDataFrame([("Casa Azul | Recife", "https://a.example.com/", "Casa", 1.0)], "title string, url string, content string, score double")
    assert any("url" in x for x in shuffles(web.result_leads(df, Request(category="imobiliárias", location="Recife"))))


def test_blocks_are_settled_in_one_stream():
    import pandas as pd

    pairs = [(1, 1, 10, 50), (1, 1, 9, 50), (1, 2, 10, 100), (1, 2, 9, 20), (7, 3, 5, 30), (7, 4, 5, 30)]
    frames = [pd.DataFrame(pairs[i : i + 1], columns=["block", "rank", "company_id", "score"]) for i in range(len(pairs))]
    got = [tuple(r) for f in storage._in_turn(iter(frames)) for r in f.itertuples(index=False)]
    assert got == [(1, 10, 50), (2, 9, 20), (3, 5, 30)]
