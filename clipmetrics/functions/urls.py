"""Address expressions: canonical form, host rules, ids, media links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipmetrics import rules
from clipmetrics.functions import text
from clipmetrics.functions.text import strip

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(url, PARTS, index)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Host name without user, port or a leading www., lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(_part(url, 2), "^.*@", ""), r":\d*$", "")
    return F.lower(F.regexp_replace(bare, "^www[.]", ""))


def host_allowed(host_col: Column, suffixes: tuple[str, ...] | list[str]) -> Column:
    found = F.lit(False)
    for suffix in suffixes:
        found = found | (host_col == suffix) | F.endswith(host_col, F.lit("." + suffix))
    return found


def preview_host_allowed(platform: Column, url: Column) -> Column:
    """Preview hosts per platform; unknown platforms have none."""
    name, h = F.lower(strip(platform)), host(url)
    found = F.lit(False)
    for key, suffixes in rules.PREVIEW_HOSTS.items():
        found = found | ((name == key) & host_allowed(h, suffixes))
    return found


def _decode(col: Column) -> Column:
    return F.try_url_decode(col)


def _encode(col: Column) -> Column:
    # URLEncoder leaves * and escapes ~; query escaping wants it the other way round.
    return F.replace(F.replace(F.url_encode(col), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(query: Column) -> Column:
    """Decoded (key, value) structs in order; pairs that do not decode or hold a semicolon are dropped."""
    pieces = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.contains(p, F.lit(";")))
    pairs = F.transform(pieces, lambda p: F.struct(
        _decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"),
        _decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v"),
    ))
    return F.filter(pairs, lambda p: p.k.isNotNull() & p.v.isNotNull())


def query_value(url: Column, name: str) -> Column:
    """First decoded value of a parameter."""
    return F.get(F.filter(query_pairs(_part(url, 4)), lambda p: p.k == name), F.lit(0)).v


def clean_query(query: Column) -> Column:
    """Tracking parameters dropped, the rest re-encoded in key order (values keep their order per key)."""
    kept = F.filter(query_pairs(query), lambda p: ~(
        F.startswith(F.lower(p.k), F.lit(rules.TRACKING_PREFIX)) | F.lower(p.k).isin(rules.TRACKING_PARAMS)
    ))
    keyed = F.transform(kept, lambda p, i: F.struct(p.k.alias("k"), i.alias("i"), p.v.alias("v")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda p: F.concat(_encode(p.k), F.lit("="), _encode(p.v))), "&")


def _plain_path(path: Column) -> Column:
    """A path with characters outside ASCII is percent-encoded, others stay as they are."""
    encoded = F.replace(_encode(F.coalesce(_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)), F.lit("+"), F.lit("%20"))
    for code, char in (("%2F", "/"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%2C", ","), ("%3A", ":"), ("%3B", ";"),
                       ("%3D", "="), ("%40", "@")):
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return F.when(F.rlike(path, F.lit(r"[^\x21-\x7e]")), encoded).otherwise(path)


def canonical_url(url: Column) -> Column:
    """http(s) address without fragment and tracking, query in key order; null otherwise."""
    url = strip(url)
    query = clean_query(_part(url, 4))
    rebuilt = F.concat(scheme(url), F.lit("://"), _part(url, 2), _plain_path(_part(url, 3)),
                       F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme(url).isin("http", "https") & (_part(url, 2) != ""), rebuilt)


def accepted(platform: Column, url: Column, host_rules: dict[str, rules.HostRule] | None = None) -> Column:
    """Whether the platform's host and path rules take this address."""
    url = strip(url)
    h, path, name = host(url), _part(url, 3), F.lower(strip(platform))
    found = F.lit(False)
    for key, rule in (host_rules or rules.HOST_RULES).items():
        ok = (name == key) & host_allowed(h, rule.suffixes) & F.rlike(path, F.lit(rule.path))
        if rule.param:
            ok = ok & (strip(F.coalesce(query_value(url, rule.param), F.lit(""))) != "")
        found = found | ok
    return found


def platform_url(platform: Column, url: Column, host_rules: dict[str, rules.HostRule] | None = None) -> Column:
    """Canonical address when the platform accepts it, else null."""
    return F.when(accepted(platform, url, host_rules), canonical_url(url))


def unwrap_redirect(url: Column, redirect_host: str = rules.REDIRECT_HOST, param: str = rules.REDIRECT_PARAM) -> Column:
    """Target of a redirect link; protocol-relative links become https; a redirect without target is blank."""
    full = F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)
    target = strip(F.coalesce(query_value(full, param), F.lit("")))
    return F.when(F.contains(host(full), F.lit(redirect_host)), F.coalesce(_decode(target), target)).otherwise(full)


def public_id(url: Column) -> Column:
    """Stable id: first 16 hex digits of SHA-1."""
    return F.left(F.sha1(url), F.lit(16))


def video_id(url: Column, *patterns: str) -> Column:
    """First group of the first matching pattern, null when none matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns])


def rebuilt_url(url: Column, prefix: str, *patterns: str) -> Column:
    return F.concat(F.lit(prefix), video_id(url, *patterns))


def media_url(col: Column, full: bool = True) -> Column:
    """Media link in its playable https form, null when it is none."""
    u = text.unescape_slashes(strip(text.unescape(col, full)))
    u = F.regexp_replace(F.regexp_replace(u, r"[,;)\]}]+$", ""), "^//", "https://")
    u = F.regexp_replace(F.replace(u, F.lit("playwm"), F.lit("play")), "^http://", "https://")
    return F.nullif(F.regexp_extract(u, r"(?s)^https://[^/?#\s]+.*$", 0), F.lit(""))


def media_urls(links: Column) -> Column:
    """media_url(link, full=False) of every link of an array.

    One step at a time: a function over an array's items evaluates an expression as often as it is written.
    """
    u = F.transform(links, lambda x: strip(text.unescape(x, False)))
    u = F.transform(u, text.unescape_slashes)
    u = F.transform(u, lambda x: F.when(F.contains(F.lit(",;)]}"), F.right(x, F.lit(1))), F.rtrim(x, F.lit(",;)]}"))).otherwise(x))
    u = F.transform(u, lambda x: F.when(F.startswith(x, F.lit("//")), F.concat(F.lit("https:"), x)).otherwise(x))
    u = F.transform(u, lambda x: F.replace(x, F.lit("playwm"), F.lit("play")))
    u = F.transform(u, lambda x: F.when(F.startswith(x, F.lit("http://")), F.concat(F.lit("https://"), F.substr(x, F.lit(8)))).otherwise(x))
    return F.transform(u, lambda x: F.when(F.rlike(x, F.lit(r"^https://[^/?#\s]")), x))


def looks_like_media(url: Column, markers: list[str] | None = None) -> Column:
    low = F.lower(url)
    found = F.lit(False)
    for marker in markers or rules.MEDIA_MARKERS:
        found = found | F.contains(low, F.lit(marker))
    return found


def captured_media_url(col: Column) -> Column:
    """Link seen in browser traffic: &amp; decoded, https only, media-looking; null otherwise."""
    u = F.regexp_replace(strip(F.replace(col, F.lit("&amp;"), F.lit("&"))), "^http://", "https://")
    return F.when(F.startswith(F.lower(u), F.lit("https://")) & looks_like_media(u, rules.CAPTURE_MARKERS), u)
