"""Hosts, domains, slugs and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public suffixes of two parts under which names are registered.
COMPOUND = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "co.jp", "or.jp", "ne.jp", "co.kr", "com.au", "net.au", "org.au",
    "com.br", "com.cn", "com.hk", "com.sg", "com.tr", "co.in", "co.il", "co.nz", "com.mx", "com.ar", "co.za",
)


def host(url: Column) -> Column:
    """The host of an http(s) URL in lower case, with no port and no leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)), r"^www\.", "")


def registrable_domain(name: Column) -> Column:
    parts = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), ".")
    return F.when(last(2).isin(*COMPOUND), last(3)).otherwise(last(2))


def slug(text: Column, most: int = 60) -> Column:
    return F.left(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(most))


def deterministic_id(prefix: str, namespace: str, key: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat(F.lit(f"{namespace}:"), key), 256), 1, 24))


# Languages that a URL's first path segment may name, and query keys that carry no identity.
LOCALES = ("en", "ru", "de", "fr", "es", "it", "pt", "zh", "ja", "ko", "nl", "pl", "tr")
TRACKING = ("fbclid", "gclid", "yclid", "mc_cid", "mc_eid", "amp", "locale", "lang")


def _segments(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1), "/"), lambda x: x != "")


def locale(url: Column) -> Column:
    """The language of a URL's first path segment (as in /de/ or /pt-br/), or null."""
    first = F.split_part(F.lower(F.try_element_at(_segments(url), F.lit(1))), F.lit("-"), F.lit(1))
    return F.when(first.isin(*LOCALES), first)


def url_key(url: Column) -> Column:
    """What makes two URLs the same page: https, host without www, path without locale and amp, other query pairs in order; empty without a host.

    Query pairs are decoded and encoded again, so that pairs written with other escapes are the same.
    """
    server = F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1)), r"^www\.", "")
    parts = _segments(url)
    parts = F.when(locale(url).isNotNull(), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
    path = F.regexp_replace(F.concat(F.lit("/"), F.array_join(parts, "/")), r"(?i:(^|/)amp$)|\.amp$", "$1")
    path = F.regexp_replace(path, r"(.)/$", "$1")
    plus = lambda x: F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%20")))
    key = lambda pair: F.lower(F.split_part(pair, F.lit("="), F.lit(1)))
    value = lambda pair: F.when(F.instr(pair, "=") > 0, F.substr(pair, F.instr(pair, "=") + 1)).otherwise("")
    decoded = lambda x: F.url_encode(F.coalesce(plus(x), x))
    kept = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(*TRACKING) & (F.lower(p) != "output=amp"))
    pairs = F.transform(kept, lambda p: F.concat(decoded(F.split_part(p, F.lit("="), F.lit(1))), F.lit("="), decoded(value(p))))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.when(server == "", "").otherwise(F.concat(F.lit("https://"), server, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


# Query keys that say where a visitor came from.
CAMPAIGN = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "yclid", "mc_cid", "mc_eid")
# Query keys, beside all that begin with utm_, that a fetcher leaves out.
UNFETCHED = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "source", "yclid", "ysclid")


def _pairs(url: Column, dropped: tuple[str, ...], fetched: bool) -> Column:
    """The query with its pairs decoded and encoded again, in their order; without dropped keys. To be fetched, pairs of no value stay and all utm_ keys go."""
    text = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%20"))), x)
    split = F.transform(
        F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p != ""),
        lambda p: F.struct(text(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.when(F.instr(p, "=") > 0, text(F.substr(p, F.instr(p, "=") + 1))).otherwise("").alias("v")),
    )
    kept = F.filter(split, lambda p: ~F.lower(p["k"]).isin(*dropped) & ~(F.lit(fetched) & F.startswith(F.lower(p["k"]), F.lit("utm_"))) & (F.lit(fetched) | (p["v"] != "")))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    return F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")


def collected_url(url: Column) -> Column:
    """A URL as collectors keep it: server in lower case without www, no doubled or final slash, no fragment, no campaign keys, no empty values; empty stays empty."""
    clean = F.trim(F.when(F.startswith(url, F.lit("/")), F.concat(F.lit("https://example.invalid"), url)).otherwise(url))
    scheme = F.lower(F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    server = F.regexp_replace(F.lower(F.regexp_extract(clean, r"^[^:/?#]+://([^/?#]*)", 1)), r"^www\.", "")
    parts = F.regexp_replace(F.regexp_extract(clean, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/{2,}", "/")
    parts = F.when(parts.isin("", "/"), "/").otherwise(F.regexp_replace(parts, "/+$", ""))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.concat(scheme, F.lit("://"), server, parts, _pairs(clean, CAMPAIGN, False)))


def reported_url(url: Column) -> Column:
    """A URL found in running text: without the punctuation that follows it, and then as collectors keep it."""
    return collected_url(F.regexp_replace(F.trim(url), r"[.,);]+$", ""))


def fetchable_url(url: Column) -> Column:
    """struct(url, error): a URL that may be fetched, with www, its own slashes and empty values, without a default port, fragment, utm_ or other unfetched keys; or why it may not.

    Hosts outside ASCII must come in their encoded (xn--) form; others are an error.
    """
    clean = F.trim(url)
    scheme = F.lower(F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    server = F.regexp_extract(clean, r"^[^:/?#]+://([^/?#]*)", 1)
    name = F.lower(F.regexp_replace(F.regexp_replace(server, r":[^:]*$", ""), r"\.+$", ""))
    port = F.regexp_extract(server, r":([^:]*)$", 1)
    number = port.try_cast("int")
    error = (
        F.when(clean.isNull() | ~scheme.isin("http", "https"), "scheme")
        .when(F.contains(server, F.lit("@")), "user information")
        .when(name == "", "no host")
        .when(F.rlike(name, F.lit(r"[^\x00-\x7F]")), "host not encoded")
        .when((port != "") & (number.isNull() | ~number.between(1, 65535)), "port")
    )
    usual = (port == "") | ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))
    path_ = F.regexp_extract(clean, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    made = F.concat(scheme, F.lit("://"), name, F.when(usual, "").otherwise(F.concat(F.lit(":"), number.cast("string"))), F.when(path_ == "", "/").otherwise(path_), _pairs(clean, UNFETCHED, True))
    return F.struct(F.when(error.isNull(), made).alias("url"), error.alias("error"))
