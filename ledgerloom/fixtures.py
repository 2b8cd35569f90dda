"""Business-record inputs derived from the TPC-H-like tables, in SQL that Spark and DuckDB read alike.

`{customer}` and so on stand for tables. Companies are groups of three customers; three sources observe them with different
spellings and gaps. Every 40th company shares a phone number with the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_G = "CAST(floor(c_custkey / 3.0) AS BIGINT)"
_SHARED = f"CASE WHEN {_G} % 40 = 1 THEN {_G} - 1 ELSE {_G} END"
_TEXT = "CAST(NULL AS VARCHAR(1))"

OBSERVATIONS = f"""
SELECT c_custkey * 10 + 1 AS obs_id, 'registry' AS provider, 'Empresa Número ' || {_G} || ' LTDA' AS name,
       lpad(CAST({_G} * 1000003 AS VARCHAR(20)), 14, '0') AS cnpj, {_TEXT} AS phone, {_TEXT} AS whatsapp, FALSE AS whatsapp_confirmed, {_TEXT} AS whatsapp_evidence,
       CASE WHEN c_custkey % 4 = 0 THEN 'Rua das Flores, ' || {_G} ELSE {_TEXT} END AS address, n_name AS city, 'São Paulo' AS state, {_TEXT} AS category, {_TEXT} AS website, {_TEXT} AS instagram,
       'https://registry.example.org/' || c_custkey AS source_url, 'r' || c_custkey AS external_id
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0
UNION ALL
SELECT c_custkey * 10 + 2, 'directory', 'EMPRÉSA NUMERO ' || {_G}, {_TEXT},
       '(11) 9' || lpad(CAST({_SHARED} AS VARCHAR(20)), 8, '7'), {_TEXT}, FALSE, {_TEXT}, CASE WHEN c_custkey % 5 = 1 THEN 'R. das Flôres ' || {_G} ELSE {_TEXT} END, n_name, 'SP', 'Restaurante', {_TEXT}, {_TEXT},
       {_TEXT}, 'd' || c_custkey
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0
UNION ALL
SELECT c_custkey * 10 + 3, 'places', 'Empresa Numero ' || {_G} || CASE WHEN c_custkey % 7 = 0 THEN ' Filial' ELSE ' ME' END, {_TEXT},
       CASE WHEN c_custkey % 2 = 1 THEN '+55 11 9' || lpad(CAST({_SHARED} AS VARCHAR(20)), 8, '7') ELSE {_TEXT} END,
       CASE WHEN c_custkey % 10 = 5 THEN '11 9' || lpad(CAST({_G} AS VARCHAR(20)), 8, '8') ELSE {_TEXT} END, c_custkey % 10 = 5, CASE WHEN c_custkey % 10 = 5 THEN 'WhatsApp ' || {_G} ELSE {_TEXT} END,
       {_TEXT}, n_name, 'são paulo', {_TEXT}, 'HTTPS://www.Site' || CAST(floor(c_custkey / 12.0) AS BIGINT) || '.example.com/' || CASE WHEN c_custkey % 2 = 0 THEN 'loja/' ELSE '' END, {_TEXT},
       'https://places.example.net/?id=' || c_custkey, 'p' || c_custkey
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey WHERE c_custkey % 5 = 0
"""

#: Stored companies to match against: every other company as an earlier search left it.
STORED = f"""
SELECT c_custkey AS company_id, 'Empresa Número ' || {_G} AS name, CASE WHEN c_custkey % 4 = 0 THEN lpad(CAST({_G} * 1000003 AS VARCHAR(20)), 14, '0') ELSE {_TEXT} END AS cnpj,
       CASE WHEN c_custkey % 6 = 0 THEN '55119' || lpad(CAST({_G} AS VARCHAR(20)), 8, '7') ELSE {_TEXT} END AS phone, CASE WHEN c_custkey % 9 = 0 THEN '55119' || lpad(CAST({_G} AS VARCHAR(20)), 8, '7') ELSE {_TEXT} END AS whatsapp,
       CASE WHEN c_custkey % 12 = 0 THEN 'https://www.site' || CAST(floor(c_custkey / 12.0) AS BIGINT) || '.example.com' ELSE {_TEXT} END AS website, n_name AS city, CASE WHEN c_custkey % 5 = 0 THEN {_TEXT} ELSE 'São Paulo' END AS state,
       CASE WHEN c_custkey % 8 = 0 THEN 'Rua das Flores, ' || {_G} ELSE {_TEXT} END AS address, CAST(c_custkey % 101 AS INTEGER) AS confidence,
       CASE WHEN c_custkey % 9 = 0 AND c_custkey % 2 = 0 THEN 'confirmed' WHEN c_custkey % 9 = 0 THEN 'unconfirmed' ELSE 'not_found' END AS whatsapp_status
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0
"""

#: Results of a search to match: one for each company that the registry and directory know.
RESULTS = f"""
SELECT c_custkey AS rank, 'EMPRESA NUMERO ' || {_G} || ' LTDA' AS name, CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST({_G} * 1000003 AS VARCHAR(20)), 14, '0') ELSE {_TEXT} END AS cnpj,
       CASE WHEN c_custkey % 4 = 1 THEN '55119' || lpad(CAST({_G} AS VARCHAR(20)), 8, '7') ELSE {_TEXT} END AS phone, {_TEXT} AS whatsapp,
       CASE WHEN c_custkey % 7 = 1 THEN 'site' || CAST(floor(c_custkey / 12.0) AS BIGINT) || '.example.com/' ELSE {_TEXT} END AS website, n_name AS city, 'SAO PAULO' AS state, 'rua das flores, ' || {_G} AS address, CAST(c_custkey % 97 AS INTEGER) AS confidence
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 1
"""


def sql(spark: SparkSession, text: str, sf_dir: str) -> DataFrame:
    tables = "region nation customer supplier part orders lineitem events documents pages conversations".split()
    return spark.sql(text.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in tables}))


def duck(text: str) -> str:
    return text.format(**{t: t for t in "region nation customer supplier part orders lineitem events documents pages conversations".split()})


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, OBSERVATIONS, sf_dir)
    strings = [n for n, t in rows.dtypes if t.startswith(("varchar", "string"))]
    return rows.withColumns({n: F.col(n).cast("string") for n in strings}).withColumn("data", F.lit(None).cast("map<string,string>"))
