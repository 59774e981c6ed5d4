"""Identifiers, URLs and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze

# Tracking parameters of a URL.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ("spm", "from", "source", "campaign", "ref")


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, no tracking parameters or fragment, parameters sorted, no closing slash.

    Text that is no http(s) URL stays as it is; NULL as ''.
    """
    u = squeeze(c)
    bare = F.regexp_replace(u, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, "^[^:]+://([^/?]*)", 1))
    path = F.regexp_extract(bare, "^[^:]+://[^/?]*([^?]*)", 1)
    path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    key = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).startswith(TRACKING_PREFIX) & ~key(p).isin(*TRACKING_KEYS))
    # keys and values are read and written anew, so one spelling of an escape remains; one without "=" gets an empty value
    read = lambda x: F.coalesce(F.try_url_decode(x), x)
    write = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.array_sort(F.transform(kept, lambda p: F.struct(read(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), read(F.regexp_extract(p, "=(.*)$", 1)).alias("v"))))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(write(p["k"]), F.lit("="), write(p["v"]))), "&")
    out = F.concat(scheme, F.lit("://"), host, path, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(F.lit("")))
    return F.when(scheme.isin("http", "https"), out).otherwise(u)


def plain_doi(c: Column) -> Column:
    d = F.lower(squeeze(c))
    d = F.regexp_replace(d, "^https?://(?:dx\\.)?doi\\.org/", "")
    return F.trim(F.regexp_replace(d, "^doi\\s*:\\s*", ""))


def text_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def document_id(source: Column, record_id: Column) -> Column:
    """``doc_`` and the first 24 hex digits of the hash of source, NUL and record id."""
    return F.concat(F.lit("doc_"), F.left(F.sha2(F.concat(source, F.char(F.lit(0)), record_id), 256), F.lit(24)))


def fingerprint(fields: dict[str, Column]) -> Column:
    """Hash of the fields as JSON with sorted keys, NULL fields kept."""
    s = F.struct(*(c.alias(k) for k, c in sorted(fields.items())))
    return text_hash(F.to_json(s, {"ignoreNullFields": "false"}))


def node_id(name: Column, kind: Column) -> Column:
    return F.to_json(F.array(name, kind))


def class_code(c: Column) -> Column:
    """Class code in upper case without enclosing brackets."""
    return F.upper(F.btrim(squeeze(c), F.lit("[]{}")))


def class_key(c: Column) -> Column:
    return F.regexp_replace(class_code(c), "[^A-Z0-9]", "")


def declares_code(query: Column, code: Column) -> Column:
    """The query names exactly this code: no letter, digit or dot beside it."""
    q, k = F.upper(squeeze(query)), class_code(code)
    return (k != "") & F.regexp_like(q, F.concat(F.lit("(?<![A-Z0-9.])\\Q"), k, F.lit("\\E(?![A-Z0-9.])")))


def flag(c: Column) -> Column:
    """true/1/yes/y and false/0/no/n as boolean; NULL for anything else."""
    v = F.lower(squeeze(c))
    return F.when(v.isin("1", "true", "yes", "y"), F.lit(True)).when(v.isin("0", "false", "no", "n"), F.lit(False))
