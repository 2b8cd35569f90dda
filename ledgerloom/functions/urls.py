"""URLs as Column expressions by regular expressions (parse_url rejects hosts that are in use)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

# fixed values
SHARED_HOSTS = (
    "facebook.com", "guiamais.com.br", "instagram.com", "linktr.ee", "maps.app.goo.gl", "solutudo.com.br", "sites.google.com",
    "tripadvisor.com.br", "wa.me", "web.facebook.com", "www.facebook.com", "www.instagram.com", "yelp.com",
)
DIRECTORY_HOSTS = (
    "facebook.com", "guiamais.com.br", "instagram.com", "linkedin.com", "linktr.ee", "maps.google.com", "solutudo.com.br",
    "tripadvisor.com.br", "wa.me", "yelp.com",
)
SENSITIVE_TERMS = ("api", "apikey", "access", "bearer", "auth", "authorization", "credential", "credentials", "key", "password", "refresh", "secret", "signature", "token")
SENSITIVE_COMPACT = ("accesstoken", "apikey", "refreshtoken")

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def _with_scheme(c: Column) -> Column:
    c = F.nullif(F.trim(c), F.lit(""))
    return F.when(F.contains(c, F.lit("://")), c).otherwise(F.concat(F.lit("https://"), c))


_NET = r"^(\[[^\]]*\]|[^:\[\]]+)(?::([0-9]*))?$"


def _taken(url: Column) -> Column:
    """struct(scheme, net, host, port, path, query) of a URL; empty texts for what it hasn't."""
    return let(
        F.struct(F.lower(_part(url, 1)).alias("scheme"), _part(url, 2).alias("net"), _part(url, 3).alias("path"), _part(url, 4).alias("query")),
        lambda p: F.struct(p["scheme"].alias("scheme"), p["net"].alias("net"), F.lower(F.regexp_extract(p["net"], _NET, 1)).alias("host"), F.regexp_extract(p["net"], _NET, 2).alias("port"), p["path"].alias("path"), p["query"].alias("query")),
    )


def _port_fits(port: Column) -> Column:
    return (port == "") | (port.rlike("^[0-9]{1,5}$") & (port.try_cast("int") <= 65535))


def _query(query: Column) -> Column:
    return F.when(F.length(query) > 1, query).otherwise(F.lit(""))


def _port(port: Column) -> Column:
    """`:port` without leading zeros; empty for none and zero."""
    number = F.regexp_replace(port, "^0+", "")
    return F.when(number != "", F.concat(F.lit(":"), number)).otherwise(F.lit(""))


def normalize_url(c: Column) -> Column:
    """Scheme http(s), https if missing; lower-case host; no credentials, fragment or slash at the end; null if it can't be."""

    def built(p: Column) -> Column:
        fits = p["scheme"].isin("http", "https") & (p["host"] != "") & ~F.contains(p["net"], F.lit("@")) & _port_fits(p["port"])
        return F.when(fits, F.concat(p["scheme"], F.lit("://"), p["host"], _port(p["port"]), F.rtrim(p["path"], F.lit("/")), _query(p["query"])))

    return let(_with_scheme(c), lambda u: let(_taken(u), built))


def host_of(normalized: Column) -> Column:
    """The host of a normalised URL without port and www."""
    net = _part(normalized, 2)
    return F.nullif(F.regexp_replace(F.regexp_replace(net, ":[0-9]+$", ""), r"^www\.", ""), F.lit(""))


def website_host(c: Column) -> Column:
    return host_of(normalize_url(c))


def is_shared(host: Column) -> Column:
    return host.isin(*SHARED_HOSTS) | F.concat(F.lit("www."), host).isin(*SHARED_HOSTS)


def identity_of(normalized: Column) -> Column:
    """The host (with an unusual port) of a normalised URL; of hosts that many share, with up to two parts of the path, null without any."""

    def named(u: Column) -> Column:
        net = F.regexp_replace(_part(u, 2), r"^www\.", "")
        host = F.when(u.startswith("http:"), F.regexp_replace(net, ":80$", "")).otherwise(F.regexp_replace(net, ":443$", ""))
        parts = F.filter(F.split(F.lower(_part(u, 3)), "/"), lambda x: x != "")
        return let(host, lambda h: F.when(~is_shared(h), h).otherwise(let(parts, lambda p: F.when(F.size(p) > 0, F.concat_ws("/", h, F.slice(p, 1, 2))))))

    return let(normalized, named)


def exact_of(normalized: Column) -> Column:
    """Host, path and query of a normalised URL."""
    return let(normalized, lambda u: F.concat(host_of(u), F.coalesce(F.nullif(F.rtrim(_part(u, 3), F.lit("/")), F.lit("")), F.lit("/")), _part(u, 4)))


def website_identity(c: Column) -> Column:
    return identity_of(normalize_url(c))


def website_exact(c: Column) -> Column:
    return exact_of(normalize_url(c))


_PRIVATE = (
    r"^(?:(?:0|10|127|22[4-9]|2[3-5][0-9])\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.|192\.0\.[02]\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\."
    r"|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.)[0-9.]*$"
)
_LOCAL = r"^localhost$|\.(?:localhost|local|internal)$|^[^.]*$|^\["


def public_url(c: Column) -> Column:
    """An http(s) URL whose host can be public: not local, not a private or reserved address, with a dot."""

    def built(p: Column) -> Column:
        def with_host(h: Column) -> Column:
            fits = p["scheme"].isin("http", "https") & (h != "") & ~F.contains(p["net"], F.lit("@")) & ~h.rlike(_PRIVATE) & ~h.rlike(_LOCAL) & _port_fits(p["port"])
            return F.when(fits, F.concat(p["scheme"], F.lit("://"), h, _port(p["port"]), p["path"], _query(p["query"])))

        return let(F.regexp_replace(p["host"], r"\.$", ""), with_host)

    return let(F.replace(F.trim(c), F.lit("&amp;"), F.lit("&")), lambda u: let(_taken(u), built))


def export_url(c: Column) -> Column:
    """A URL fit for export: no credentials, no fragment, no query parameters that may hold secrets."""
    scheme, net, path, query = F.lower(_part(c, 1)), _part(c, 2), _part(c, 3), F.regexp_replace(_part(c, 4), r"^\?", "")
    net = F.regexp_replace(net, "^.*@", "")
    host = F.regexp_replace(F.lower(F.regexp_replace(net, ":[0-9]*$", "")), r"\.$", "")
    port = F.regexp_extract(net, r":([0-9]+)$", 1)

    def sensitive(pair: Column) -> Column:
        key = F.lower(F.split(pair, "=")[0])
        words = F.regexp_extract_all(key, F.lit("([a-z0-9]+)"), F.lit(1))
        return F.regexp_replace(key, "[^a-z0-9]+", "").isin(*SENSITIVE_COMPACT) | F.arrays_overlap(words, F.array(*[F.lit(x) for x in SENSITIVE_TERMS]))

    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~sensitive(p)), "&")
    tail = F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(F.lit("")), path, tail))


def is_http_url(c: Column) -> Column:
    return F.coalesce(c.rlike("^https?://[^/?#:@]"), F.lit(False))


def first_public(urls: Column) -> Column:
    """The first URL of an array that isn't a social profile."""
    return F.get(F.filter(urls, lambda u: is_http_url(u) & ~F.lower(_part(u, 2)).isin("facebook.com", "www.facebook.com", "instagram.com", "www.instagram.com")), F.lit(0))


def first_in_list(c: Column) -> Column:
    """The first URL of a list joined by semicolons that can be normalised."""
    return F.get(F.filter(F.transform(F.split(c, ";"), lambda u: normalize_url(u)), lambda u: u.isNotNull()), F.lit(0))
