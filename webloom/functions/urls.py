"""URL functions as column expressions: nothing here leaves the JVM.

Components follow the generic URI syntax, so characters that stricter parsers refuse (blanks, bars, underscores in hosts) are kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query
_URI = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: user, host, port
_AUTHORITY = r"(?s)^(?:(.*)@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"

#: Query parameters that don't change the content; utm_* goes as well.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid", "mc_cid", "mc_eid")
DEFAULT_PORTS = ("443", "80")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URI, group)


def _of_authority(authority: Column, group: int) -> Column:
    return F.regexp_extract(authority, _AUTHORITY, group)


def form_encode(text: Column) -> Column:
    """Query escaping with + for a blank; letters, digits and - _ . ~ stay."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def clean_path(path: Column) -> Column:
    """The shortest equal path: empty and . segments go, .. takes the one before; an empty path stays."""
    rooted = path.startswith("/")
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))

    def step(done: Column, s: Column) -> Column:
        climbs = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        up = F.when(climbs, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(rooted, done).otherwise(F.concat(done, F.array(F.lit(".."))))
        return F.when(s == "..", up).otherwise(F.concat(done, F.array(s)))

    joined = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    return F.when(path == "", "").when(rooted, F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", ".").otherwise(joined))


def clean_query(query: Column) -> Column:
    """The query without tracking parameters, decoded and encoded again, sorted by name; equal names keep their order."""
    raw = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.contains(";"))
    pairs = F.transform(
        raw,
        lambda p, i: F.struct(
            F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"),
            i.alias("i"),
            F.try_url_decode(F.when(p.contains("="), F.regexp_replace(p, "(?s)^[^=]*=", "")).otherwise("")).alias("v"),
        ),
    )
    name = lambda p: F.lower(p["k"])
    kept = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull() & ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(form_encode(p["k"]), F.lit("="), form_encode(p["v"]))), "&")


def canonical(url: Column) -> Column:
    """One spelling for urls of one content: https, lower-case host, no default port, fragment, tracking parameter or trailing slash, clean path."""
    authority = _part(url, 2)
    user, host, port = (_of_authority(authority, g) for g in (1, 2, 3))
    bare = F.regexp_replace(F.lower(host), r"^\[|\]$", "")
    host_port = F.when(port.isin(*DEFAULT_PORTS), bare).when(authority.rlike(":[0-9]*$") & (port != ""), F.concat(F.lower(host), F.lit(":"), port)).otherwise(F.lower(host))
    path = clean_path(_part(url, 3))
    path = F.when(F.length(path) > 1, F.rtrim(path, F.lit("/"))).otherwise(path)
    query = clean_query(_part(url, 4))
    start = F.when(authority == "", F.lit("https:")).otherwise(F.concat(F.lit("https://"), F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""), host_port))
    return F.concat(start, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def frontier_domain(url: Column) -> Column:
    """The parsed host without a leading www. (removed before the case is lowered)."""
    return F.lower(F.regexp_replace(F.regexp_replace(_of_authority(_part(url, 2), 2), r"^\[|\]$", ""), r"^www\.", ""))


def web_domain(url: Column) -> Column:
    """The text between :// and the next / or :, in lower case; '' without ://."""
    rest = F.split(url, "://", 2)
    return F.when(url.contains("://"), F.lower(F.substring_index(F.substring_index(rest[1], "/", 1), ":", 1))).otherwise(F.when(url.isNotNull(), ""))


def crawler_domain(url: Column) -> Column:
    """web_domain without a leading www."""
    return F.regexp_replace(web_domain(url), r"^www\.", "")


def resolve_link(base: Column, href: Column) -> Column:
    """The absolute form of a link; '' for links that are relative to the page's folder and for other schemes."""
    origin = F.concat(F.substring_index(base, "://", 1), F.lit("://"), F.substring_index(F.split(base, "://", 2)[1], "/", 1))
    return (
        F.when(href.startswith("http://") | href.startswith("https://"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/") & base.contains("://"), F.concat(origin, href))
        .otherwise(F.lit(""))
    )


def redirect_target(href: Column, parameter: str = "uddg") -> Column:
    """The target of a search engine's redirect link, which is encoded twice; a direct http link stays; else ''."""
    query = _part(href, 4)
    raw = F.regexp_extract(query, f"(?:^|&){parameter}=([^&]*)", 1)
    once = F.try_url_decode(raw)
    target = F.coalesce(F.try_url_decode(once), once, raw)
    return F.when(raw != "", target).when(href.startswith("http"), href).otherwise(F.lit(""))


def with_scheme(url: Column) -> Column:
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit("https://"), url))


def is_crawlable(href: Column) -> Column:
    """Links that are neither empty, nor fragments, nor scripts."""
    return (href != "") & ~href.startswith("#") & ~href.startswith("javascript:")


def priority(importance: Column, last_seen: Column, now: Column, weight: Column) -> Column:
    """importance x ln(1 + hours since last_seen, not below 0) x weight; a url never seen has importance x weight."""
    hours = F.greatest((F.unix_micros(now) - F.unix_micros(last_seen)) / F.lit(3.6e9), F.lit(0.0))
    return F.when(last_seen.isNull(), importance * weight).otherwise(importance * F.log1p(hours) * weight)
