"""Canonical keys: registry numbers, accession numbers, domains, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.sources.tables import norm_null


def cik10(c: Column | str) -> Column:
    """Ten-digit CIK from any of its written forms (prefix, blanks, trailing .0, no padding); NULL if none."""
    c = F.trim(norm_null(c))
    digits = F.regexp_extract(c, r"^(?i:cik)?[\s:#-]*0*([0-9]{1,10})(?:\.0*)?$", 1)
    return F.when(digits == "", None).otherwise(F.lpad(digits, 10, "0"))


def accession(c: Column | str) -> Column:
    """NNNNNNNNNN-YY-NNNNNN from an accession number with or without dashes and blanks; NULL if it is none."""
    d = F.regexp_replace(norm_null(c), r"[^0-9]", "")
    return F.when(
        F.length(d) == 18, F.concat_ws("-", F.substring(d, 1, 10), F.substring(d, 11, 2), F.substring(d, 13, 6))
    )


def domain_norm(c: Column | str) -> Column:
    """Host of a URL or domain, without scheme, credentials, www., port, path, query and final dot; lower case."""
    c = F.lower(F.trim(norm_null(c)))
    c = F.regexp_replace(c, r"^[a-z][a-z0-9+.-]*://", "")
    c = F.regexp_replace(c, r"[/?#].*$", "")
    c = F.regexp_replace(c, r"^[^@]*@", "")
    c = F.regexp_replace(c, r":\d+$", "")
    c = F.regexp_replace(c, r"^(?:www\.)+", "")
    c = F.rtrim(F.regexp_replace(c, r"\.+$", ""))
    return F.when(c == "", None).otherwise(c)
