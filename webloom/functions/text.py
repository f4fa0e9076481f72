"""Text, media-type and status functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def media_type(content_type: Column) -> Column:
    """The type without parameters; an empty one is text/html."""
    given = F.coalesce(F.nullif(content_type, F.lit("")), F.lit("text/html"))
    return F.trim(F.substring_index(F.lower(given), ";", 1))


def parser_of(content_type: Column) -> Column:
    """Which reader takes a document, by parts of its media type, in this order."""
    kind = media_type(content_type)
    feed = kind.contains("xml") | kind.contains("rss") | kind.contains("atom")
    return F.when(kind.contains("html"), "html").when(kind.contains("json"), "json").when(feed, "xml").when(kind.contains("csv"), "csv").otherwise("text")


def status_class(status: Column) -> Column:
    return F.when(status.isNull(), "err").when(status < 300, "2xx").when(status < 400, "3xx").when(status < 500, "4xx").otherwise("5xx")


def badge(status: Column) -> Column:
    return F.when((status >= 200) & (status < 300), "ok").when((status >= 300) & (status < 400), "warn").otherwise("err")


def collapse(text: Column) -> Column:
    """Runs of blanks become one, three or more line ends two; outer white space goes."""
    blanks = F.regexp_replace(text, r"[ \t\r\f]{2,}", " ")
    return F.regexp_replace(F.regexp_replace(blanks, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def truncated(text: Column, limit: int) -> Column:
    """At most limit bytes of the text's UTF-8 form, cut between characters."""
    data = F.encode(text, "utf-8")
    lead = lambda at: F.conv(F.hex(F.substring(data, at, 1)), 16, 10).cast("int")
    # the first byte that is cut off tells whether a character was split; go back to where it starts
    back = F.aggregate(F.array(*[F.lit(i) for i in range(4)]), F.lit(-1), lambda a, i: F.when((a < 0) & ((lead(F.lit(limit + 1) - i) < 128) | (lead(F.lit(limit + 1) - i) >= 192)), i).otherwise(a))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(data, F.lit(1), F.lit(limit) - F.greatest(back, F.lit(0))), "utf-8"))


def escaped(text: Column) -> Column:
    """Text for HTML."""
    out = text
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(name))
    return out


def kilobytes(size: Column) -> Column:
    return F.concat(F.format_number(size / 1024, 1), F.lit(" KB"))


def preview(results: Column | str = "content", short: int = 500, long: int = 3000) -> Column:
    """(short, long): a result's text cut for display."""
    text = F.col(results) if isinstance(results, str) else results
    return F.struct(F.substring(text, 1, short).alias("short"), F.substring(text, 1, long).alias("long"))


def preview_extras(extras: Column, most: int = 6, width: int = 80) -> Column:
    """At most ``most`` extra fields by name, values cut."""
    return F.map_from_entries(F.slice(F.array_sort(F.transform(F.map_entries(extras), lambda e: F.struct(e["key"].alias("key"), F.substring(e["value"], 1, width).alias("value")))), 1, most))


def rate_score(rate: Column, mean_ms: Column) -> Column:
    """rate x ln(1 + 1000 / mean latency); the rate alone without a latency."""
    return F.when(mean_ms <= 0, rate).otherwise(rate * F.log1p(F.lit(1000.0) / mean_ms))


def output_record(url: Column, domain: Column, content_hash: Column, status: Column, fetched_at: Column, body: Column, fields: Column) -> Column:
    """A record of the output stream: unix seconds, the body's size, and fields under the prefix field_."""
    return F.struct(
        url.alias("url"), domain.alias("domain"), content_hash.alias("content_hash"), status.alias("status_code"), F.unix_seconds(fetched_at).alias("fetched_at"),
        F.coalesce(F.octet_length(body), F.lit(0)).alias("body_size"), F.transform_keys(fields, lambda k, _: F.concat(F.lit("field_"), k)).alias("fields"),
    )


def rfc3339(ts: Column) -> Column:
    """A time in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def content_hash(text: Column) -> Column:
    """XXH64 (seed 0) in hex without leading zeros; the built-in function has another seed."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for batch in texts:
            yield batch.map(lambda t: f"{xxhash.xxh64_intdigest(t.encode()):x}", na_action="ignore")

    # made here: a module-level one would need a session on import
    return F.pandas_udf(run, "string")(text)
