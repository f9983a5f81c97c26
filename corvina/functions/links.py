"""Links and domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def domain(url: Column) -> Column:
    """The host in small letters without www. and port; null where there is none."""
    return F.regexp_replace(F.lower(F.call_function("try_parse_url", url, F.lit("HOST"))), "^www\\.", "")


def canonical_url(url: Column) -> Column:
    """https, the host without www., the path without a slash at its end; query and fragment go."""
    path = F.regexp_replace(F.coalesce(F.call_function("try_parse_url", url, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.when(domain(url).isNotNull(), F.concat(F.lit("https://"), domain(url), path))


def in_domain(host: Column, of: Column) -> Column:
    """Equal or a subdomain."""
    return (host == of) | host.endswith(F.concat(F.lit("."), of))


def merchant_name(host: Column) -> Column:
    """The part of a host before its ending, as a title."""
    return F.initcap(F.regexp_replace(F.element_at(F.split(host, "\\."), 1), "[-_]+", " "))
