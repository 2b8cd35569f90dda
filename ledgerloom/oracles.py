"""DuckDB SQL that gives the same rows as the queries of the same names: written apart from them, as their check."""

from __future__ import annotations

from .fixtures import OBSERVATIONS, RESULTS, STORED, duck
from .functions.phones import AREA_CODES
from .functions.text import CONCEPT_STEMS, CONCEPTS, GENERIC_PAGE_NAMES, STATES, STOP_WORDS
from .functions.urls import SENSITIVE_COMPACT, SENSITIVE_TERMS, SHARED_HOSTS
from .operators.planning import SEMANTIC_CATEGORIES


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower(strip_accents({x})), 'ß', 'ss'), '\s+', ' ', 'g'))"


def company(x: str) -> str:
    return f"trim(regexp_replace(' ' || trim(regexp_replace({norm(x)}, '[^a-z0-9]+', ' ', 'g')), '( (eireli|ltda|me|epp))+$', ''))"


def identity(x: str) -> str:
    return rf"nullif(trim(regexp_replace({norm(x)}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '')"


def state(x: str) -> str:
    return "CASE " + identity(x) + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + f" ELSE {identity(x)} END"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def tax_id(x: str) -> str:
    return f"CASE WHEN length({digits(x)}) = 14 THEN {digits(x)} END"


def phone(x: str) -> str:
    """The national number of a plain number (no links)."""
    w = rf"regexp_replace(trim({x}), '(?i)\s*(?:ramal|r\.?|ext(?:ens(?:a|ã)o)?|x)\s*[:.\-]?\s*[0-9]+\s*$', '')"
    d = digits(w)
    n = (
        f"CASE WHEN {d} LIKE '0055%' AND length({d}) IN (14, 15) THEN substr({d}, 5) WHEN {d} LIKE '55%' AND length({d}) IN (12, 13) THEN substr({d}, 3) "
        f"WHEN {d} LIKE '0%' AND length({d}) IN (11, 12) THEN substr({d}, 2) WHEN {d} LIKE '0%' AND length({d}) IN (13, 14) THEN substr({d}, 4) ELSE {d} END"
    )
    return (
        f"CASE WHEN NOT ((starts_with(ltrim({w}), '+') AND {d} NOT LIKE '55%') OR ({d} LIKE '00%' AND {d} NOT LIKE '0055%')) AND substr({n}, 1, 2) IN {_list(AREA_CODES)} "
        f"AND ((length({n}) = 11 AND substr({n}, 3, 1) = '9') OR (length({n}) = 10 AND substr({n}, 3, 1) IN ('2', '3', '4', '5'))) THEN {n} END"
    )


def url(x: str) -> str:
    """Normalised URL, for inputs without port and credentials."""
    u = f"(CASE WHEN contains(trim({x}), '://') THEN trim({x}) ELSE 'https://' || nullif(trim({x}), '') END)"
    p = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?'"
    part = lambda i: f"regexp_extract({u}, {p}, {i})"
    return f"CASE WHEN lower({part(1)}) IN ('http', 'https') AND {part(2)} <> '' THEN lower({part(1)}) || '://' || lower({part(2)}) || rtrim({part(3)}, '/') || CASE WHEN length({part(4)}) > 1 THEN {part(4)} ELSE '' END END"


def host(normalised: str) -> str:
    return f"nullif(regexp_replace(regexp_extract({normalised}, '^[a-z]+://([^/?#]*)', 1), '^www\\.', ''), '')"


RESOLUTION = rf"""
obs AS ({duck(OBSERVATIONS)}),
n0 AS (
  SELECT *, {tax_id("cnpj")} AS k_cnpj, {company("name")} AS k_name, {phone("phone")} AS k_phone, {phone("whatsapp")} AS k_whatsapp, {url("website")} AS n_url,
         {identity("address")} AS k_address, {identity("city")} AS k_city, {state("state")} AS k_state
  FROM obs),
n AS (
  SELECT *, {host("n_url")} AS k_host, {host("n_url")} AS k_site,
         {host("n_url")} || coalesce(nullif(rtrim(regexp_extract(n_url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), ''), '/') || regexp_extract(n_url, '(\?.*)$', 1) AS k_exact
  FROM n0),
keyed AS (
  SELECT obs_id, k_cnpj AS cnpj, k_address AS address, 'cnpj' AS reason, k_cnpj AS key FROM n WHERE k_cnpj IS NOT NULL
  UNION SELECT obs_id, k_cnpj, k_address, 'phone', k_phone FROM n WHERE k_phone IS NOT NULL
  UNION SELECT obs_id, k_cnpj, k_address, 'phone', k_whatsapp FROM n WHERE k_whatsapp IS NOT NULL
  UNION SELECT obs_id, k_cnpj, k_address, 'name_address', k_name || '|' || k_address || '|' || coalesce(k_city, '') || '|' || coalesce(k_state, '') FROM n WHERE k_name <> '' AND k_address IS NOT NULL
  UNION SELECT obs_id, k_cnpj, k_address, 'website', k_exact FROM n WHERE k_exact IS NOT NULL
  UNION SELECT obs_id, k_cnpj, k_address, 'name_location', k_name || '|' || k_city || '|' || coalesce(k_state, '') FROM n WHERE k_name <> '' AND k_city IS NOT NULL),
ordered AS (
  SELECT obs_id, row_number() OVER (ORDER BY coalesce(k_cnpj, ''), k_name, coalesce(k_phone, ''), coalesce(k_whatsapp, ''), coalesce(k_site, ''), coalesce(k_address, ''), coalesce(k_city, ''), coalesce(k_state, ''), obs_id) AS ord
  FROM n),
branched AS (
  SELECT *, CASE WHEN reason = 'name_location' AND min(address) OVER (PARTITION BY reason, key) <> max(address) OVER (PARTITION BY reason, key) THEN coalesce('=' || address, '-') ELSE '' END AS branch
  FROM keyed),
told AS (
  SELECT *, coalesce(min(cnpj) OVER (PARTITION BY reason, key, branch) <> max(cnpj) OVER (PARTITION BY reason, key, branch), false) AS mixed FROM branched),
parts AS (SELECT *, CASE WHEN mixed THEN cnpj ELSE '' END AS part FROM told WHERE NOT mixed OR cnpj IS NOT NULL),
stars AS (
  SELECT DISTINCT first_value(p.obs_id) OVER (PARTITION BY reason, key, branch, part ORDER BY ord) AS a, p.obs_id AS b, reason
  FROM parts p JOIN ordered o ON o.obs_id = p.obs_id),
hosted AS (
  SELECT n.*, ord, count(*) OVER (PARTITION BY k_host) AS members, list_distinct(string_split(k_name, ' ')) AS tokens, list_filter([k_phone, k_whatsapp], lambda x: x IS NOT NULL) AS numbers
  FROM n JOIN ordered USING (obs_id) WHERE k_host IS NOT NULL AND k_host NOT IN {_list(SHARED_HOSTS)}),
pairs AS (
  SELECT l.obs_id AS a, r.obs_id AS b
  FROM hosted l JOIN hosted r ON l.k_host = r.k_host AND l.ord < r.ord AND l.members <= 50
  WHERE NOT coalesce(l.k_address <> r.k_address, false) AND NOT coalesce(l.k_cnpj <> r.k_cnpj, false)
    AND (l.k_exact = r.k_exact OR list_has_any(l.numbers, r.numbers) OR coalesce(l.k_address = r.k_address, false)
      OR (l.k_name <> '' AND r.k_name <> '' AND (l.k_name = r.k_name OR l.k_name IN {_list(GENERIC_PAGE_NAMES)} OR r.k_name IN {_list(GENERIC_PAGE_NAMES)}
        OR (len(list_intersect(l.tokens, r.tokens)) >= 2 AND len(list_intersect(l.tokens, r.tokens)) / least(len(l.tokens), len(r.tokens)) >= 0.75))))),
edges AS (SELECT a, b, reason FROM stars WHERE a <> b UNION SELECT a, b, 'website' FROM pairs)
"""
CLUSTERS = """
both1 AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach1(x, y) AS (SELECT obs_id, obs_id FROM n UNION SELECT x, b FROM reach1 JOIN both1 ON y = a),
comp1 AS (SELECT x AS obs_id, min(y) AS root FROM reach1 GROUP BY x),
mixed1 AS (SELECT root, coalesce(min(k_cnpj) <> max(k_cnpj), false) AS mixed FROM comp1 JOIN n USING (obs_id) GROUP BY root),
kept AS (
  SELECT e.* FROM edges e JOIN comp1 c ON c.obs_id = e.a JOIN mixed1 m ON m.root = c.root JOIN n l ON l.obs_id = e.a JOIN n r ON r.obs_id = e.b
  WHERE NOT m.mixed OR l.k_cnpj IS NOT DISTINCT FROM r.k_cnpj),
both2 AS (SELECT a, b FROM kept UNION SELECT b, a FROM kept),
reach2(x, y) AS (SELECT obs_id, obs_id FROM n UNION SELECT x, b FROM reach2 JOIN both2 ON y = a),
members AS (SELECT x AS obs_id, min(y) AS cluster FROM reach2 GROUP BY x)
"""
_CANON = {"name": "nullif(k_name, '')", "phone": "k_phone", "whatsapp": "k_whatsapp", "address": "k_address", "city": "k_city", "state": "k_state", "category": identity("category"), "website": "k_site", "instagram": identity("instagram"), "cnpj": "k_cnpj"}
_STANDARD = {"phone": "'55' || k_phone", "whatsapp": "'55' || k_whatsapp", "website": "n_url", "cnpj": "k_cnpj"}
_ASCII = "regexp_replace({0}, '[\\x00-\\x7F]', '', 'g')"
_DISPLAY = {
    "phone": " + CASE WHEN k_phone IS NOT NULL THEN 2 ELSE 0 END",
    "whatsapp": " + CASE WHEN k_whatsapp IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN whatsapp_confirmed THEN 10 ELSE 0 END",
    "website": " + CASE WHEN starts_with(n_url, 'https:') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(n_url, '^[a-z]+://[^/?]*$') THEN 2 ELSE 0 END",
}
FIELDS = tuple(_CANON)
VALUES = (
    "quality AS (SELECT obs_id, 3 + " + " + ".join(f"CASE WHEN {f} <> '' THEN 1 ELSE 0 END" for f in FIELDS) + " + CASE WHEN source_url <> '' THEN 2 ELSE 0 END + CASE WHEN whatsapp_confirmed THEN 4 ELSE 0 END AS quality FROM n),\nvals AS (\n"
    + "\nUNION ALL\n".join(
        f"SELECT cluster, obs_id, provider, quality, '{f}' AS field, {c} AS canonical, {f} AS raw, {_STANDARD.get(f, f'trim({f})')} AS standard, length({_ASCII.format(f)}){_DISPLAY.get(f, '')} AS display FROM n JOIN members USING (obs_id) JOIN quality USING (obs_id) WHERE {c} IS NOT NULL AND {f} <> ''"
        for f, c in _CANON.items()
    )
    + f"""),
grouped AS (
  SELECT cluster, field, canonical, row_number() OVER (PARTITION BY cluster, field ORDER BY count(DISTINCT provider) DESC, count(DISTINCT obs_id) DESC, max(quality) DESC, canonical) AS nth, count(DISTINCT provider) AS support, list_sort(list(DISTINCT provider)) AS providers
  FROM vals GROUP BY cluster, field, canonical),
spelled AS (
  SELECT cluster, field, canonical, standard, row_number() OVER (PARTITION BY cluster, field, canonical ORDER BY count(DISTINCT provider) DESC, count(DISTINCT obs_id) DESC, max(display) DESC, length(raw), {norm("raw")}, raw) AS nth
  FROM vals GROUP BY cluster, field, canonical, raw, standard),
chosen AS (
  SELECT g.cluster, g.field, g.canonical, s.standard AS value, g.support, g.providers
  FROM grouped g JOIN spelled s USING (cluster, field, canonical) WHERE g.nth = 1 AND s.nth = 1)"""
)
SCORES = (
    "wide AS (SELECT cluster, "
    + ", ".join(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}, coalesce(max(CASE WHEN field = '{f}' THEN support END), 0) AS s_{f}" for f in FIELDS)
    + """, len(list_distinct(flatten(list(CASE WHEN field IN ('phone', 'whatsapp') THEN providers ELSE [] END)))) AS contact FROM chosen GROUP BY cluster),
seen AS (SELECT cluster, count(*) AS candidate_count, count(DISTINCT provider) AS n_providers, count(DISTINCT nullif(source_url, '')) AS urls FROM n JOIN members USING (obs_id) GROUP BY cluster),
said AS (SELECT m.cluster, true AS evidenced FROM n JOIN members m USING (obs_id) JOIN wide w ON w.cluster = m.cluster WHERE n.whatsapp_confirmed AND n.whatsapp_evidence IS NOT NULL AND '55' || n.k_whatsapp = w.whatsapp GROUP BY m.cluster),
scored AS (
  SELECT w.*, candidate_count, CAST(least(100, 10 + least(34, 12 + 10 * (n_providers - 1)) + CASE WHEN urls > 1 THEN 8 WHEN urls = 1 THEN 5 ELSE 0 END
    + CASE WHEN cnpj IS NOT NULL THEN 18 + CASE WHEN s_cnpj >= 2 THEN 12 ELSE 0 END ELSE 0 END
    + CASE WHEN phone IS NOT NULL OR whatsapp IS NOT NULL THEN 10 + CASE WHEN contact >= 2 THEN 10 ELSE 0 END ELSE 0 END
    + CASE WHEN website IS NOT NULL THEN 8 + CASE WHEN s_website >= 2 THEN 7 ELSE 0 END ELSE 0 END
    + CASE WHEN address IS NOT NULL THEN 6 + CASE WHEN s_address >= 2 THEN 5 ELSE 0 END ELSE 0 END
    + CASE WHEN city IS NOT NULL OR state IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN s_name >= 2 THEN 8 ELSE 0 END + CASE WHEN evidenced THEN 5 ELSE 0 END) AS INTEGER) AS confidence
  FROM wide w JOIN seen USING (cluster) LEFT JOIN said USING (cluster))"""
)
_RANK = f"row_number() OVER (ORDER BY confidence DESC, {company('name')}, coalesce({identity('city')}, ''), coalesce({state('state')}, ''), coalesce(cnpj, ''), coalesce(phone, ''), cluster)"
_LEVEL = "CASE WHEN confidence >= 75 THEN 'high' WHEN confidence >= 45 THEN 'medium' ELSE 'low' END"


def _token_sql(x: str) -> str:
    canonical = "CASE " + " ".join(f"WHEN starts_with(w, '{s}') THEN '{c}'" for s, c in CONCEPT_STEMS) + " WHEN length(w) > 4 AND ends_with(w, 's') THEN substr(w, 1, length(w) - 1) ELSE w END"
    return f"list_distinct(list_transform(list_filter(regexp_extract_all({norm(x)}, '[a-z0-9]+'), lambda w: w NOT IN {_list(STOP_WORDS)} AND length(w) >= 3), lambda w: {canonical}))"


CATEGORY_TEXTS = """
SELECT p_partkey AS id, (['Restaurante italiano', 'Clínica odontológica', 'Serviços contábeis', 'Oficina mecânica', 'Padarias e doces', 'Dentistas'])[p_partkey % 6 + 1] AS requested,
       (['Restaurantes', 'Odontologia estética', 'Contabilidade', 'Mecânica automotiva', 'Doces', 'Restaurante italiano', NULL])[p_partkey % 7 + 1] AS category,
       (['Padaria e Doces Silva', 'Contabilidade Souza', 'Clínica Sorriso', 'Restaurante Italiano do Zé', 'Auto Mecânica'])[p_partkey % 5 + 1] AS name
FROM {part}
"""

PAGED = """
WITH leads AS (SELECT event_type AS provider, CAST(user_id % 4 AS INTEGER) AS variation, CAST(event_id % 7 AS INTEGER) AS page, event_id AS position, user_id * 8 + event_id % 8 AS identity FROM events),
pages AS (SELECT provider, variation, page, count(*) AS raw, count(*) FILTER (position % 5 = 0) AS rejected,
          CASE WHEN variation = 0 AND page = 3 THEN NULL WHEN variation = 1 AND page = 2 THEN 'c1' ELSE 'c' || page END AS cursor FROM leads GROUP BY provider, variation, page),
stops AS (SELECT *, cursor IS NULL OR row_number() OVER (PARTITION BY provider, variation, cursor ORDER BY page) > 1 AS stop, row_number() OVER (PARTITION BY provider, variation ORDER BY page) AS nth FROM pages),
reached AS (SELECT * FROM (SELECT *, coalesce(bool_or(stop) OVER (PARTITION BY provider, variation ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM stops) WHERE NOT stopped AND nth <= 6),
seen AS (SELECT l.*, row_number() OVER (PARTITION BY provider, identity ORDER BY variation, page, position) = 1 AS first FROM leads l SEMI JOIN reached r ON r.provider = l.provider AND r.variation = l.variation AND r.page = l.page),
new AS (SELECT *, count(*) OVER (PARTITION BY provider) AS news, row_number() OVER (PARTITION BY provider ORDER BY variation, page, position) AS nth FROM seen WHERE first),
ends AS (SELECT provider, variation, page, position, news FROM new WHERE nth = least(news, 300)),
counted AS (SELECT s.provider, s.variation, count(*) FILTER (first) AS fresh, count(*) FILTER (NOT first) AS duplicates FROM seen s JOIN ends e USING (provider)
            WHERE e.news < 300 OR (s.variation, s.page, s.position) <= (e.variation, e.page, e.position) GROUP BY s.provider, s.variation)
"""


#: Scores of results and stored companies that may be the same; then each rank in turn takes the best one that is left.
MATCHES = f"""r AS ({duck(RESULTS)}), s AS ({duck(STORED)}),
x AS (SELECT rank, company_id,
  CASE WHEN r.cnpj = s.cnpj THEN 100 ELSE 0 END + CASE WHEN r.phone IN (s.phone, s.whatsapp) THEN 50 ELSE 0 END + CASE WHEN {url('r.website')} = {url('s.website')} THEN 30 ELSE 0 END
  + CASE WHEN {company('r.name')} = {company('s.name')} AND (({norm('r.city')} = {norm('s.city')} AND (s.state IS NULL OR r.state IS NULL OR {norm('r.state')} = {norm('s.state')})) OR {norm('r.address')} = {norm('s.address')}) THEN 20 ELSE 0 END AS score
  FROM r JOIN s ON ({company('r.name')} = {company('s.name')} OR r.cnpj = s.cnpj OR r.phone IN (s.phone, s.whatsapp) OR {url('r.website')} = {url('s.website')}) WHERE coalesce(r.cnpj = s.cnpj, true))"""
IN_TURN = """
y AS MATERIALIZED (SELECT * FROM x WHERE score > 0),
ranks AS MATERIALIZED (SELECT rank, row_number() OVER (ORDER BY rank) AS i FROM (SELECT DISTINCT rank FROM y)),
turn AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS company_id, CAST(NULL AS BIGINT) AS score
  UNION ALL
  SELECT i + 1, CASE WHEN b IS NULL THEN taken ELSE list_append(taken, b.c) END, rank, b.c, b.s
  FROM (SELECT t.i, any_value(t.taken) AS taken, k.rank, max({'s': CAST(y.score AS BIGINT), 'c': CAST(y.company_id AS BIGINT)}) FILTER (NOT list_contains(t.taken, y.company_id)) AS b
        FROM turn t JOIN ranks k ON k.i = t.i + 1 JOIN y ON y.rank = k.rank GROUP BY t.i, k.rank) g)"""

ORACLES: dict[str, str] = {
    "norm_text": f"SELECT doc_id, {norm('text')} AS text_norm FROM documents",
    "norm_fingerprint": f"SELECT doc_id, sha256({norm('text')}) AS fp FROM documents",
    "company_name_norm": f"WITH obs AS ({duck(OBSERVATIONS)}) SELECT obs_id, {company('name')} AS name_norm, {identity('name')} AS name_identity, {state('state')} AS state_code, {tax_id('cnpj')} AS tax_id FROM obs",
    "phone_normalize": f"WITH obs AS ({duck(OBSERVATIONS)}) SELECT obs_id, '55' || {phone('phone')} AS phone, CASE length({phone('phone')}) WHEN 11 THEN 'mobile' WHEN 10 THEN 'landline' END AS kind, '55' || {phone('whatsapp')} AS whatsapp FROM obs",
    "url_normalize": f"WITH u AS (SELECT page_id, {url('url')} AS url_norm FROM pages) SELECT page_id, url_norm, {host('url_norm')} AS host FROM u",
    "url_export": rf"""
WITH u AS (SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'token=' || page_id || '&lang=pt&Api-Key=x&page=' || page_id % 7 AS u FROM (SELECT page_id, regexp_extract(url, '^([^#]*)', 1) AS url FROM pages)),
q AS (SELECT page_id, u, string_split(regexp_extract(u, '\?(.*)$', 1), '&') AS items FROM u)
SELECT page_id, regexp_extract(u, '^([^?]*)', 1) || coalesce('?' || nullif(array_to_string(list_filter(items, lambda p: p <> '' AND regexp_replace(lower(string_split(p, '=')[1]), '[^a-z0-9]+', '', 'g') NOT IN {_list(SENSITIVE_COMPACT)}
         AND NOT list_has_any(regexp_extract_all(lower(string_split(p, '=')[1]), '[a-z0-9]+'), [{", ".join(f"'{t}'" for t in SENSITIVE_TERMS)}])), '&'), ''), '') AS export_url
FROM q""",
    "block_keys": f"WITH {RESOLUTION} SELECT reason, count(*) AS n, count(DISTINCT key) AS keys FROM keyed GROUP BY reason",
    "block_edges": f"WITH {RESOLUTION} SELECT a, b, string_agg(reason, ',' ORDER BY reason) AS reasons FROM edges GROUP BY a, b",
    "host_pairs": f"WITH {RESOLUTION} SELECT a, b FROM pairs",
    "clusters_constrained": f"WITH RECURSIVE {RESOLUTION}, {CLUSTERS} SELECT obs_id, cluster FROM members",
    "clusters_unconstrained": f"WITH RECURSIVE {RESOLUTION}, {CLUSTERS} SELECT obs_id, root FROM comp1",
    "field_selection": f"WITH RECURSIVE {RESOLUTION}, {CLUSTERS}, {VALUES} SELECT cluster, field, canonical, value, CAST(support AS INTEGER) AS support FROM chosen",
    "field_alternatives": f"WITH RECURSIVE {RESOLUTION}, {CLUSTERS}, {VALUES} SELECT cluster, field, string_agg(standard, '|' ORDER BY {norm('standard')}, standard) AS alternatives FROM (SELECT DISTINCT cluster, field, standard FROM vals) GROUP BY cluster, field",
    "confidence_score": f"WITH RECURSIVE {RESOLUTION}, {CLUSTERS}, {VALUES}, {SCORES} SELECT cluster, confidence, {_LEVEL} AS confidence_level, CAST(candidate_count AS INTEGER) AS candidate_count FROM scored",
    "resolved_ranked": f"WITH RECURSIVE {RESOLUTION}, {CLUSTERS}, {VALUES}, {SCORES} SELECT CAST({_RANK} AS INTEGER) AS rank, cluster, name, phone, whatsapp, address, city, state, category, website, cnpj, confidence, {_LEVEL} AS confidence_level FROM scored",
    "source_contribution": f"WITH RECURSIVE {RESOLUTION}, {CLUSTERS}, p AS (SELECT DISTINCT cluster, provider FROM n JOIN members USING (obs_id)), c AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS k FROM p) SELECT provider, count(*) AS results, count(*) FILTER (k = 1) AS exclusive FROM c GROUP BY provider",
    "match_reasons": f"WITH RECURSIVE {RESOLUTION}, {CLUSTERS}, r AS (SELECT DISTINCT cluster, reason FROM kept JOIN members ON obs_id = a) SELECT cluster, string_agg(reason, ',' ORDER BY reason) AS match_reasons FROM r GROUP BY cluster",
    "token_coverage_qualify": f"""
WITH t AS ({duck(CATEGORY_TEXTS)}),
s AS (SELECT *, {_token_sql('requested')} AS q, {_token_sql('category')} AS o, {_token_sql('name')} AS m FROM t),
k AS (SELECT *, len(list_intersect(q, o)) / len(q) AS share, list_intersect(q, {list(CONCEPTS)}) AS qc, list_intersect(o, {list(CONCEPTS)}) AS oc FROM s)
SELECT id, CASE WHEN category IS NOT NULL AND {norm('requested')} = {norm('category')} THEN 'true' WHEN category IS NOT NULL AND len(qc) > 0 AND len(oc) > 0 AND len(list_intersect(qc, oc)) = 0 THEN 'false'
            WHEN share >= 0.67 THEN 'true' WHEN len(list_intersect(q, m)) = len(q) THEN 'true' END AS category_match,
       CAST(CASE WHEN category IS NOT NULL AND {norm('requested')} = {norm('category')} THEN 99 WHEN category IS NOT NULL AND len(qc) > 0 AND len(oc) > 0 AND len(list_intersect(qc, oc)) = 0 THEN 95
            WHEN share = 1 THEN 96 WHEN share >= 0.67 THEN 88 WHEN len(list_intersect(q, m)) = len(q) THEN 82 ELSE 25 END AS INTEGER) AS qualification_confidence
FROM k""",
    "category_lookup": "SELECT id, CASE " + " ".join(f"WHEN contains({norm('requested')}, '{t}') THEN '{terms[0]}'" for triggers, terms in SEMANTIC_CATEGORIES for t in triggers) + f" END AS concept FROM ({duck(CATEGORY_TEXTS)})",
    "near_exact_doc_dedup": f"WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source, {norm('text')} ORDER BY doc_id) AS nth FROM documents) SELECT doc_id, source FROM d WHERE nth = 1",
    "discovery_metrics": "WITH e AS (SELECT event_type AS provider, CAST(user_id % 4 AS INTEGER) AS variation, event_id % 11 = 0 AS rejected, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) > 1 AS duplicate, user_id % 10 AS page FROM events) SELECT provider, variation, count(*) AS raw, count(*) FILTER (rejected) AS rejected, count(*) FILTER (NOT rejected AND duplicate) AS duplicates, count(*) FILTER (NOT rejected AND NOT duplicate) AS new, count(DISTINCT page) AS pages FROM e GROUP BY provider, variation",
    "discovery_rollup": "WITH e AS (SELECT event_type AS provider, CAST(user_id % 4 AS INTEGER) AS variation, event_id % 11 = 0 AS rejected, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) > 1 AS duplicate, user_id % 10 AS page FROM events) SELECT provider, CAST(variation AS VARCHAR) AS variation, count(*) AS raw, count(*) FILTER (rejected) AS rejected, count(*) FILTER (NOT rejected AND duplicate) AS duplicates, count(*) FILTER (NOT rejected AND NOT duplicate) AS new, count(DISTINCT page) AS pages FROM e GROUP BY ROLLUP (provider, variation)",
    "search_outcome": "WITH r AS (SELECT user_id AS search_id, event_type AS provider, event_id % 3 <> 0 AS succeeded, event_id % 13 = 0 AS limit_reached, CASE WHEN event_id % 3 = 0 THEN 'timeout ' || event_id % 5 END AS error FROM events) SELECT search_id, CASE WHEN NOT bool_or(succeeded) THEN 'failed' WHEN bool_or(error IS NOT NULL OR limit_reached) THEN 'partial' ELSE 'completed' END AS status, nullif(substr(string_agg(provider || ': ' || error, '; ' ORDER BY provider, error), 1, 2000), '') AS error_message FROM r GROUP BY search_id",
    "status_rollforward": "WITH s AS (SELECT user_id AS search_id, (['planning', 'discovering', 'deduplicating', 'enriching', 'qualifying', 'persisting'])[event_id % 6 + 1] AS stage, CASE WHEN event_id % 10 = 0 THEN 'completed' ELSE 'running' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) SELECT search_id, stage, status, CAST(CASE WHEN status = 'completed' THEN 100 ELSE CASE stage WHEN 'planning' THEN 5 WHEN 'discovering' THEN 55 WHEN 'deduplicating' THEN 65 WHEN 'enriching' THEN 78 WHEN 'qualifying' THEN 86 ELSE 90 END END AS INTEGER) AS progress FROM s WHERE nth = 1",
    "crash_recovery": "WITH s AS (SELECT user_id AS search_id, CASE WHEN max(event_id) % 2 = 0 THEN 'running' ELSE 'completed' END AS status, CAST(NULL AS VARCHAR) AS error_message FROM events GROUP BY user_id), h AS (SELECT DISTINCT user_id AS search_id FROM events WHERE event_id % 50 = 0) SELECT s.search_id, CASE WHEN status = 'running' AND h.search_id IS NULL THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' AND h.search_id IS NULL THEN 'interrupted' END AS error_message FROM s LEFT JOIN h ON h.search_id = s.search_id",
    "cache_budget": "WITH e AS (SELECT event_type, CAST(event_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, CAST(event_id AS VARCHAR)) AS n, sum(CAST(length(props) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts DESC, CAST(event_id AS VARCHAR) ROWS UNBOUNDED PRECEDING) AS b FROM events) SELECT event_type, key FROM e WHERE n <= 100 AND b <= 800",
    "ttl_fresh": "WITH e AS (SELECT user_id AS key, max(ts) AS ts FROM events GROUP BY user_id), m AS (SELECT max(ts) AS now FROM events) SELECT key, ts FROM e, m WHERE ts + INTERVAL 7 DAY > now",
    "request_gaps": "WITH r AS (SELECT event_id AS request_id, event_type AS host, ts, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap FROM events) SELECT request_id, host FROM r WHERE gap < 60",
    "best_match_existing": f"WITH {MATCHES}, b AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY score DESC, company_id DESC) AS nth FROM x WHERE score > 0) SELECT rank, company_id, CAST(score AS INTEGER) AS score FROM b WHERE nth = 1",
    "assigned_matches": f"WITH RECURSIVE {MATCHES}, {IN_TURN} SELECT rank, company_id, CAST(score AS INTEGER) AS score FROM turn WHERE company_id IS NOT NULL",
    "persist_companies": f"""
WITH RECURSIVE {MATCHES}, {IN_TURN},
t AS (SELECT * FROM turn WHERE company_id IS NOT NULL),
rows AS (
  SELECT coalesce(nullif(s.cnpj, ''), r.cnpj) AS cnpj FROM s LEFT JOIN t USING (company_id) LEFT JOIN r ON r.rank = t.rank
  UNION ALL SELECT cnpj FROM r WHERE rank NOT IN (SELECT rank FROM t))
SELECT count(*) AS companies, count(cnpj) AS with_tax_id FROM rows""",
    "contact_predicates": """
SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 1 ELSE 0 END AS same_number, CASE WHEN c_custkey % 4 < 2 THEN 1 ELSE 0 END AS supported,
       CASE WHEN c_custkey % 6 = 0 THEN 'even; third' WHEN c_custkey % 2 = 0 THEN 'even' WHEN c_custkey % 3 = 0 THEN 'third' END AS reasons,
       CASE WHEN c_custkey % 5 = 2 THEN 0 WHEN c_custkey % 5 = 1 OR c_custkey % 2 = 1 THEN 1 ELSE 0 END AS refs_valid FROM customer""",
    "first_evidence": "SELECT user_id % 40 AS page_id, event_type AS value, CAST(event_id % 2 AS VARCHAR) AS url, min(event_id) AS seq FROM events GROUP BY ALL",
    "result_page_json": """
WITH p AS (SELECT CAST(o_custkey AS INTEGER) AS rank, o_orderdate AS created_at, o_orderkey AS result_id FROM orders ORDER BY 1, 2, 3 LIMIT 50)
SELECT '[' || string_agg('{"rank":' || rank || ',"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || '","result_id":' || result_id || '}', ',' ORDER BY rank, created_at, result_id) || ']' AS items,
       (SELECT count(*) FROM orders) AS total, 50 AS "limit", 0 AS "offset" FROM p""",
    "upsert_enrich": f"""
WITH r AS ({duck(RESULTS)}), s AS ({duck(STORED)})
SELECT s.company_id, coalesce(s.phone, r.phone) AS phone, coalesce(s.address, r.address) AS address, coalesce(s.city, r.city) AS city, coalesce(s.state, r.state) AS state, coalesce(s.cnpj, r.cnpj) AS cnpj,
       coalesce(s.website, {url('r.website')}) AS website,
       CASE WHEN r.rank % 4 = 1 THEN '5511988887777' WHEN r.rank % 4 = 2 AND s.whatsapp_status <> 'confirmed' THEN '5511988887777' ELSE s.whatsapp END AS whatsapp,
       CASE WHEN r.rank % 4 = 1 THEN 'confirmed' WHEN r.rank % 4 = 2 AND s.whatsapp_status <> 'confirmed' THEN 'unconfirmed' ELSE s.whatsapp_status END AS whatsapp_status, greatest(s.confidence, r.confidence) AS confidence
FROM r JOIN s ON s.company_id = r.rank + 2""",
    "new_companies": f"WITH r AS ({duck(RESULTS)}) SELECT rank, {company('name')} AS normalized_name, sha256({company('name')}) AS name_fingerprint, {url('website')} AS website, 'not_found' AS whatsapp_status FROM r",
    "constraint_violations": f"WITH s AS ({duck(STORED)}) SELECT company_id, 'confidence_range' AS rule FROM s WHERE confidence + 5 NOT BETWEEN 0 AND 100 UNION ALL SELECT company_id, 'number_needs_status' FROM s WHERE whatsapp IS NOT NULL AND whatsapp_status = 'not_found' UNION ALL SELECT company_id, 'confirmed_needs_number' FROM s WHERE whatsapp IS NULL AND whatsapp_status = 'confirmed' UNION ALL SELECT company_id, 'tax_id_shape' FROM s WHERE NOT regexp_matches(cnpj, '^[0-9]{{14}}$')",
    "result_page": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS INTEGER) END AS rank, o_orderdate AS created_at, o_orderkey AS result_id FROM orders ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END ASC NULLS LAST, o_orderdate, o_orderkey LIMIT 50 OFFSET 100",
    "provider_runs_join": "WITH runs AS (SELECT event_type AS provider, user_id AS search_id FROM events), src AS (SELECT * FROM (VALUES ('click', 'Clicks'), ('view', 'Views'), ('purchase', 'Purchases')) t(provider, display_name)) SELECT provider, display_name, count(*) AS runs FROM runs JOIN src USING (provider) GROUP BY provider, display_name",
    "missing_sources": "SELECT DISTINCT event_type AS provider FROM events WHERE event_type NOT IN ('click', 'view')",
    "contact_decision": f"""
WITH e AS (
  SELECT c_custkey AS company_id, '(11) 9' || lpad(CAST(c_custkey * 7 % 1000 AS VARCHAR), 8, '6') AS phone,
         CASE WHEN c_custkey % 5 = 0 THEN '5511' || '9' || lpad(CAST(c_custkey AS VARCHAR), 8, '5') ELSE '(11) 9' || lpad(CAST(c_custkey AS VARCHAR), 8, '5') END AS value,
         (['direct_link', 'structured_field', 'explicit_label', 'claimed_number', 'generic_phone'])[c_custkey % 5 + 1] AS evidence_type,
         CASE WHEN c_custkey % 7 = 0 THEN 'http://localhost/x' ELSE 'https://site' || c_custkey || '.example.com/contato' END AS source_url, c_custkey % 3 <> 0 AS official
  FROM customer)
SELECT company_id, '55' || {phone('phone')} AS phone, CASE WHEN evidence_type <> 'generic_phone' THEN '55' || {phone('value')} END AS whatsapp,
       CASE WHEN evidence_type = 'generic_phone' THEN 'not_found' WHEN NOT contains(source_url, 'localhost') AND official AND evidence_type IN ('direct_link', 'structured_field', 'explicit_label') THEN 'confirmed' ELSE 'unconfirmed' END AS status
FROM e""",
    "place_leads": f"""
WITH p AS (
  SELECT p_partkey AS id, 'Imóveis ' || p_name AS name, (['real_estate_agent', 'real_estate_service', 'restaurant', 'property_management'])[p_partkey % 4 + 1] AS cat, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size / 50.0 END AS conf,
         p_partkey % 360 - 180.0 AS x, p_partkey % 170 - 85.0 AS y, CASE WHEN p_partkey % 11 = 0 THEN 'permanently_closed' END AS st FROM part)
SELECT 'overture:' || id AS external_id, name, 'Imobiliária' AS category FROM p
WHERE x + 1 >= -60 AND x <= 20 AND y + 1 >= -40 AND y <= 30 AND cat IN ('real_estate_agent', 'property_management', 'real_estate_service') AND (conf IS NULL OR conf >= 0.5) AND st IS NULL""",
    "html_contacts": """
SELECT c_custkey AS page_id, 'phone' AS field, '55119' || lpad(CAST(c_custkey AS VARCHAR), 8, '7') AS value, 'tel_link' AS evidence_type FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, 'whatsapp', '55119' || lpad(CAST(c_custkey AS VARCHAR), 8, '8'), 'whatsapp_link' FROM customer WHERE c_custkey % 4 = 1
UNION ALL SELECT c_custkey, 'address', 'Rua das Flores, ' || c_custkey, 'address_element' FROM customer WHERE c_custkey % 4 = 2
UNION ALL SELECT c_custkey, 'instagram', 'https://www.instagram.com/loja' || c_custkey || '/', 'instagram_link' FROM customer WHERE c_custkey % 4 = 3""",
    "token_overlap": f"SELECT id, len(list_intersect(list_filter(string_split({norm('requested')}, ' '), lambda w: length(w) >= 4), list_filter(string_split({norm('coalesce(category, name)')}, ' '), lambda w: length(w) >= 4))) > 0 AS shares FROM ({duck(CATEGORY_TEXTS)})",
    "url_identity": rf"""
WITH u AS (SELECT page_id, url, {url('url')} AS u FROM pages)
SELECT page_id, {host('u')} AS identity, {host('u')} || coalesce(nullif(rtrim(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), ''), '/') || regexp_extract(u, '(\?.*)$', 1) AS exact,
       regexp_extract(url, '^([^#]*)', 1) AS public FROM u""",
    "nearest_phone": "SELECT s_suppkey, '55119' || lpad(CAST(s_suppkey AS VARCHAR), 8, '8') AS number FROM supplier",
    "site_crawl": """
SELECT 'https://site' || s_suppkey || '.example.com' AS start, 'https://site' || s_suppkey || '.example.com' AS url, 0 AS depth FROM supplier
UNION ALL SELECT 'https://site' || s_suppkey || '.example.com', 'https://site' || s_suppkey || '.example.com/contato', 1 FROM supplier
UNION ALL SELECT 'https://site' || s_suppkey || '.example.com', 'https://site' || s_suppkey || '.example.com/sobre', 1 FROM supplier""",
    "osm_leads": """
WITH e AS (SELECT *, s_suppkey % 50 + 1 AS id, row_number() OVER (PARTITION BY s_suppkey % 50 + 1 ORDER BY s_suppkey) AS nth FROM supplier WHERE s_suppkey % 9 <> 0)
SELECT 'osm:node:' || id AS external_id, s_name AS name, '+55 11 3' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS phone, 'https://site' || s_suppkey || '.example.com' AS website,
       lpad(CAST(s_suppkey AS VARCHAR), 14, '0') AS cnpj, 'https://www.openstreetmap.org/node/' || id AS source_url FROM e WHERE nth = 1""",
    "web_leads": """
SELECT sha256('https://site' || c_custkey || '.example.com/') AS external_id, 'Imobiliária ' || c_name AS name, 'São Paulo' AS city, 'imobiliárias' AS category,
       '(11) 9' || lpad(CAST(c_custkey AS VARCHAR), 8, '7') AS phone, '11) 9' || lpad(CAST(c_custkey AS VARCHAR), 8, '7') AS whatsapp, 'https://site' || c_custkey || '.example.com/' AS website FROM customer WHERE c_custkey % 4 <> 0""",
    "query_variations": """
WITH kinds(kind, category, location, position, term) AS (VALUES
  (0, 'imobiliária', 'São Paulo', 0, 'imobiliária'), (0, 'imobiliária', 'São Paulo', 1, 'imobiliárias'), (0, 'imobiliária', 'São Paulo', 2, 'corretora de imóveis'), (0, 'imobiliária', 'São Paulo', 3, 'corretor de imóveis'),
  (1, 'dentistas', 'Rio de Janeiro', 0, 'dentistas'), (1, 'dentistas', 'Rio de Janeiro', 1, 'dentista'), (1, 'dentistas', 'Rio de Janeiro', 2, 'clínica odontológica'), (1, 'dentistas', 'Rio de Janeiro', 3, 'consultório odontológico'),
  (2, 'padaria artesanal', 'Recife', 0, 'padaria artesanal'), (2, 'padaria artesanal', 'Recife', 1, 'padaria artesanals'),
  (4, 'oficina mecânica', 'Bahia', 0, 'oficina mecânica'), (4, 'oficina mecânica', 'Bahia', 1, 'oficinas mecânicas'), (4, 'oficina mecânica', 'Bahia', 2, 'mecânica automotiva'), (4, 'oficina mecânica', 'Bahia', 3, 'reparo automotivo'))
SELECT n_nationkey, category, location, position, term || ' em ' || location AS variation FROM nation JOIN kinds ON n_nationkey % 5 = kind
UNION ALL SELECT n_nationkey, NULL, NULL, p, 'contador' || s FROM nation, (VALUES (0, ''), (1, ' telefone contato "site oficial"'), (2, ' WhatsApp')) t(p, s) WHERE n_nationkey % 5 = 3""",
    "valid_leads": f"WITH obs AS ({duck(OBSERVATIONS)}) SELECT obs_id, CASE WHEN obs_id % 7 <> 3 OR (whatsapp IS NOT NULL AND whatsapp_evidence IS NOT NULL AND source_url IS NOT NULL) THEN 1 ELSE 0 END AS valid FROM obs",
    "tax_id_check": """
WITH d AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 AS VARCHAR), 14, '0') AS t FROM orders),
x AS (SELECT *, list_transform(string_split(t, ''), lambda q: CAST(q AS INTEGER)) AS q FROM d),
y AS (SELECT *, list_sum(list_transform(list_zip(q[1:12], [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]), lambda p: p[1] * p[2])) % 11 AS a, list_sum(list_transform(list_zip(q[1:13], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]), lambda p: p[1] * p[2])) % 11 AS b FROM x)
SELECT o_orderkey, CASE WHEN q[13] = CASE WHEN a < 2 THEN 0 ELSE 11 - a END AND q[14] = CASE WHEN b < 2 THEN 0 ELSE 11 - b END AND len(list_distinct(q)) > 1 THEN t END AS tax_id FROM y""",
    "presentation": "WITH p AS (SELECT *, '9' || lpad(CAST(c_custkey AS VARCHAR), 8, '7') AS n FROM customer) SELECT c_custkey, '+55 (11) ' || substr(n, 1, 5) || '-' || substr(n, 6) AS phone, CAST(least(100, greatest(0, c_custkey % 250 - 50)) AS INTEGER) AS confidence, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' / SP' ELSE 'SP' END AS location, CASE WHEN c_custkey % 3 = 0 THEN chr(39) || '=' || c_name ELSE c_name END AS cell FROM p",
    "classifier_batches": "WITH r AS (SELECT c_custkey AS id, c_nationkey AS search_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) SELECT id, search_id, CAST((n - 1) // 4 AS INTEGER) AS batch, 'C' || ((n - 1) % 4 + 1) AS ref FROM r WHERE n <= 10",
    "search_counters": "SELECT c_nationkey AS search_id, count(*) AS results, count(*) FILTER (c_custkey % 3 = 0) AS whatsapp, count(*) FILTER (c_custkey % 6 = 0) AS confirmed, count(*) FILTER (c_custkey % 4 = 0) AS enriched, count(*) FILTER (c_custkey % 5 = 0) AS classified FROM customer GROUP BY c_nationkey",
    "enrichment_totals": "WITH r AS (SELECT s_suppkey, s_suppkey % 3 <> 0 AS attempted, CASE WHEN s_suppkey % 5 = 1 THEN lpad(CAST(s_suppkey AS VARCHAR), 12, '0') || ': timeout' END AS error FROM supplier) SELECT count(*) FILTER (attempted) AS attempted, count(*) FILTER (attempted AND error IS NULL) AS enriched, count(*) FILTER (NOT attempted) AS skipped, array_to_string((list(error ORDER BY error) FILTER (error IS NOT NULL))[1:25], '|') AS errors, CASE WHEN count(*) > 50 THEN 1 ELSE 0 END AS limit_reached FROM r",
    "robots_filter": f"WITH u AS (SELECT page_id, url, html, {url('url')} AS u FROM pages) SELECT page_id FROM u WHERE strlen(html) <= 512000 AND NOT (length({host('u')}) % 3 = 0 AND starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/en/'))",
    "official_sites": "SELECT s_suppkey AS cluster FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0",
    "preferred_phone": "SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 2 = 0 THEN '2' ELSE '3' END || s_suppkey AS phone FROM supplier",
    "persist_results": f"SELECT rank, confidence FROM ({duck(RESULTS)})",
    "html_links_ranked": """
WITH l AS (SELECT s_suppkey AS k, unnest([
    {'p': '/sobre', 'r': 3}, CASE WHEN s_suppkey % 2 = 0 THEN {'p': '/fale-conosco', 'r': 0} ELSE {'p': '/a', 'r': 0} END, CASE WHEN s_suppkey % 3 = 0 THEN {'p': '/x', 'r': 2} END]) AS l FROM supplier)
SELECT k AS page_id, 'https://site' || k || '.example.com' || l.p AS target, l.r AS rank, CAST(row_number() OVER (PARTITION BY k ORDER BY l.r, length(l.p), l.p) AS INTEGER) AS place FROM l WHERE l IS NOT NULL""",
    "paged_collection": PAGED + "SELECT provider, variation, page, position, CASE WHEN news >= 300 THEN 1 ELSE 0 END AS limit_reached FROM new WHERE nth <= 300",
    "paged_metrics": PAGED + """
SELECT r.provider, r.variation, sum(r.raw)::BIGINT AS raw, sum(r.rejected)::BIGINT AS rejected, coalesce(any_value(d.duplicates), 0) AS duplicates, coalesce(any_value(d.fresh), 0) AS new, count(*) AS pages, CASE WHEN any_value(e.news) >= 300 THEN 1 ELSE 0 END AS limit_reached
FROM reached r JOIN ends e USING (provider) LEFT JOIN counted d ON d.provider = r.provider AND d.variation = r.variation
WHERE e.news < 300 OR (r.variation, r.page) <= (e.variation, e.page) GROUP BY r.provider, r.variation""",
    "finished_searches": PAGED + """,
m AS (SELECT r.provider, r.variation, count(*) AS pages FROM reached r JOIN ends e USING (provider) WHERE e.news < 300 OR (r.variation, r.page) <= (e.variation, e.page) GROUP BY r.provider, r.variation),
s AS (SELECT m.provider, sum(coalesce(d.fresh, 0))::BIGINT AS new, sum(m.pages)::BIGINT AS pages, count(*) AS variations FROM m LEFT JOIN counted d USING (provider, variation) GROUP BY m.provider)
SELECT 7 AS search_id, coalesce(s.provider, f.provider) AS provider, new, pages, variations, CASE WHEN f.provider IS NULL THEN 'succeeded' WHEN coalesce(new, 0) > 0 THEN 'partial' ELSE 'failed' END AS status
FROM s FULL JOIN (VALUES ('click'), ('nowhere')) f(provider) ON f.provider = s.provider""",
    "geocode_areas": """
SELECT 'Á ' || n_name AS location, 'Á ' || n_name || ', Brasil' AS query,
       CASE WHEN ok THEN n_nationkey - 10.0 END AS south, CASE WHEN ok THEN CAST(n_nationkey AS DOUBLE) END AS north, CASE WHEN ok THEN -46.5 END AS west, CASE WHEN ok THEN -40.0 END AS east, CASE WHEN ok THEN n_name END AS city, CASE WHEN ok THEN 'SP' END AS state
FROM (SELECT *, n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0 AS ok FROM nation)""",
    "robots_policy": r"""
WITH u AS (SELECT page_id, url, lower(nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1), '')) AS origin, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
s AS (SELECT *, CASE WHEN length(origin) % 11 > 0 THEN ([200, 200, 403, 404, 429, 503, 200])[length(origin) % 7 + 1] END AS status FROM u)
SELECT page_id, CASE WHEN status IS NULL OR status = 404 THEN 'allowed' WHEN status = 403 THEN 'denied' WHEN status IN (429, 503) THEN 'error'
  WHEN starts_with(path, '/en/1') THEN 'allowed' WHEN starts_with(path, '/en/') OR starts_with(path, '/de') THEN 'denied' ELSE 'allowed' END AS robots FROM s""",
    "marker_evidence": """
WITH n AS (SELECT s_suppkey AS k, lpad(CAST(s_suppkey AS VARCHAR), 8, '5') AS five, lpad(CAST(s_suppkey AS VARCHAR), 8, '6') AS six, lpad(CAST(s_suppkey AS VARCHAR), 8, '7') AS seven, lpad(CAST(s_suppkey AS VARCHAR), 8, '8') AS eight FROM supplier WHERE s_suppkey % 9 <> 0),
e AS (SELECT k, 'direct_link' AS evidence_type, '55119' || seven AS number FROM n WHERE k % 4 = 0 UNION ALL SELECT k, 'explicit_label', '55119' || eight FROM n WHERE k % 4 = 1
  UNION ALL SELECT k, 'direct_link', '55119' || six FROM n WHERE k % 4 = 3 UNION ALL SELECT k, 'explicit_label', unnest(list_distinct(['55119' || five, '55119' || six])) FROM n WHERE k % 4 = 3)
SELECT k AS page_id, evidence_type, number, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS official FROM e""",
    "retry_delays": """
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 100 AS DOUBLE) WHEN c_custkey % 4 = 1 THEN greatest(0.0, c_custkey % 60 * 60.0 - 30) END AS asked FROM customer)
SELECT c_custkey, asked, least(60.0, coalesce(asked, 0.5 * pow(2, c_custkey % 9))) AS wait FROM r""",
    "redacted_fields": "SELECT c_custkey AS id, c_name AS name, '***' AS api_key, '***' AS token, c_custkey AS n, '***' AS auth, c_name AS page FROM customer",
    "classifier_counters": """
SELECT (SELECT count(DISTINCT event_id % 1000) FROM events WHERE event_id % 3 <> 0) AS calls, (SELECT count(*) FROM events WHERE event_id % 3 = 0) AS cache_hits,
  (SELECT string_agg(d, '|' ORDER BY seq) FROM (SELECT 'refused ' || event_id % 4 AS d, min(event_id) AS seq FROM events WHERE event_id % 100 = 7 GROUP BY 1)) AS diagnostics""",
    "hydrated_results": """
SELECT o_orderkey AS result_id, c_name AS name, s.providers, coalesce(e.n, 0)::INTEGER AS evidence FROM orders JOIN customer ON c_custkey = o_custkey
LEFT JOIN (SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS providers FROM lineitem GROUP BY 1) s ON s.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) e ON e.l_orderkey = o_orderkey""",
    "persist_evidence": f"""
WITH r AS ({duck(RESULTS)})
SELECT rank * 10 AS result_id, rank * 100 AS company_id, 'whatsapp' AS contact_type, unnest(['direct_link', 'explicit_label']) AS evidence_type, CASE WHEN rank % 2 = 0 THEN 1 ELSE 0 END AS official FROM r WHERE rank % 3 > 0
UNION ALL SELECT rank * 10, rank * 100, 'phone', 'tel_link', 1 FROM r WHERE phone = CASE WHEN rank % 2 = 0 THEN phone ELSE '551130001111' END""",
}
