"""URL expressions, by regular expression: URLs with spaces or non-ASCII hosts keep their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty where there is none."""
    bare = F.regexp_replace(F.regexp_extract(F.trim(url), AUTHORITY, 1), r"^.*@", "")
    return F.lower(F.regexp_replace(bare, r":[0-9]*$", ""))


def domain(url: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def _encoded(text: Column) -> Column:
    plain = F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, port kept, user and fragment dropped, utm_ parameters dropped, one trailing slash off, query encoded anew."""
    raw = F.trim(url)
    port = F.regexp_extract(F.regexp_extract(raw, AUTHORITY, 1), r":([0-9]+)$", 1)
    path = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
    pairs = F.filter(F.split(F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_"))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(F.substring_index(p, "=", 1)), F.lit("="), _encoded(F.regexp_replace(p, "^[^=]*=?", "")))), "&")
    whole = F.concat(F.lower(F.regexp_extract(raw, SCHEME, 1)), F.lit("://"), host(url), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host(url) == "", F.substring_index(raw, "#", 1)).otherwise(whole)


def suffixes(name: Column) -> Column:
    """A host and the hosts above it."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def stable_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 16))


def hash_key(*parts: Column) -> Column:
    """SHA-256 of the parts, one on a line; a null part is empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def with_source(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with source_id and source_type of the source (source_id, source_type, priority, host) whose host is the row's domain, above it or below it on a dot; of several the first by priority, then id.

    Hosts meet by equality of their suffixes, once for each domain.
    """
    domains = rows.select("domain").distinct()
    own = known.select("*", F.explode(suffixes(F.col("host"))).alias("suffix"))
    above = domains.select("domain", F.explode(suffixes(F.col("domain"))).alias("suffix")).join(known.withColumn("suffix", F.col("host")), "suffix")
    below = domains.join(own, domains["domain"] == own["suffix"])
    met = above.select("domain", "priority", "source_id", "source_type").union(below.select("domain", "priority", "source_id", "source_type"))
    best = met.groupBy("domain").agg(F.min(F.struct("priority", "source_id", "source_type")).alias("best"))
    return rows.join(best, "domain", "left").select(*rows.columns, "best.source_id", "best.source_type")
