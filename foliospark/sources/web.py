"""Web sources: admission of urls, routing of PDF answers, recognised words from tab-separated files."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType


@F.pandas_udf(BooleanType())
def _public(host: pd.Series) -> pd.Series:
    def one(h: str | None) -> bool:
        try:
            ip = ipaddress.ip_address((h or "").strip("[]"))
        except ValueError:
            return True  # a name: resolved where it is fetched
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)

    return host.map(one)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def admitted(url: Column) -> Column:
    """http or https, with a host that is no private address; only literal addresses leave the JVM."""
    h = host(url)
    literal = h.rlike(r"^\[|^[0-9.]+$")
    return scheme(url).isin("http", "https") & (h != "") & (h != "localhost") & F.when(literal, _public(h)).otherwise(True)


def route(url: Column, html: Column) -> Column:
    """viewer: an embedded PDF viewer; pdf: the path ends so; else html."""
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    return F.when(html.rlike(r"(?i)<embed[^>]*type=[\"']?application/pdf"), "viewer").when(path.endswith(".pdf"), "pdf").otherwise("html")
