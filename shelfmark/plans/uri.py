"""Search links: ``search:`` and ``searchtool:`` URIs with a query and a scope, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded(text: Column) -> Column:
    """Plus signs are blanks; a percent sign without two hexadecimal digits stays as it is."""
    safe = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(safe)


def scope_of(text: Column) -> Column:
    """Trimmed, without quotes, slashes as backslashes and none at the end but after a drive; null if nothing is left."""
    plain = F.replace(F.regexp_replace(F.trim(text), '^"+|"+$', ""), F.lit("/"), F.lit("\\"))
    cut = F.when(F.length(F.regexp_replace(plain, r"\\+$", "\\\\")) == 3, F.regexp_replace(plain, r"\\+$", "\\\\")).otherwise(F.regexp_replace(plain, r"\\+$", ""))
    kept = F.when(plain.rlike(r"^[A-Za-z]:\\+$"), cut).otherwise(F.regexp_replace(plain, r"\\+$", ""))
    return F.when(kept != "", kept)


def parsed(uri: Column) -> Column:
    """struct(query, scope); both null for other schemes. Of repeated keys the last one that says something counts, and a
    link without any key is a query as a whole."""
    known = F.lower(F.substring_index(uri, ":", 1)).isin("search", "searchtool") & F.contains(uri, F.lit(":"))
    rest = F.regexp_replace(F.regexp_extract(uri, "(?s)^[^:]*:(.*)$", 1), r"^\?+", "")
    pairs = F.filter(F.split(rest, "&"), lambda p: F.contains(p, F.lit("=")))
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    value = lambda p: decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1))
    asked = F.filter(F.transform(F.filter(pairs, lambda p: key(p).isin("query", "q")), lambda p: F.trim(value(p))), lambda v: v != "")
    crumb = lambda p: F.when(key(p) != "crumb", value(p)).when(F.lower(value(p)).rlike("(?s)^location:.*"), F.regexp_extract(value(p), "(?s)^[^:]*:(.*)$", 1))
    places = F.filter(F.transform(F.filter(pairs, lambda p: key(p).isin("scope", "location", "crumb")), crumb), lambda v: v.isNotNull())
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1))
    whole = F.when(~F.contains(rest, F.lit("=")) & (F.trim(decoded(rest)) != ""), F.trim(decoded(rest)))
    return F.struct(F.when(known, F.coalesce(last(asked), whole)).alias("query"), F.when(known, scope_of(last(places))).alias("scope"))
