"""Names, links and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pluvia.config import REALTIME_BASE_URL, VARIABLE

# Fixed value: pattern of a link target on an index page.
LINK_PATTERN = '<a href="(.*?)"'


def dotted(name: Column) -> Column:
    """Station name as a column name: spaces become dots."""
    return F.translate(name, " ", ".")


def spaced(name: Column) -> Column:
    """Station name from a column name: dots become spaces."""
    return F.translate(name, ".", " ")


def basename(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def issue_of_url(url: Column) -> Column:
    """The 10-digit issue id inside a file address."""
    return F.regexp_extract(basename(url), r"(\d{10})", 1)


def links(html: Column) -> Column:
    """All link targets of an index page, in page order."""
    return F.regexp_extract_all(html, F.lit(LINK_PATTERN), F.lit(1))


def realtime_url(
    link: Column, hour: Column, base: str = REALTIME_BASE_URL, variable: str = VARIABLE
) -> Column:
    """Address of one issue from its folder link (``cfs.YYYYMMDD/``) and hour."""
    day = link.substr(5, 8)
    return F.concat(
        F.lit(base), link.substr(1, 12), F.lit("/"), hour,
        F.lit(f"/time_grib_01/{variable}.01."), day, hour, F.lit(".daily.grb2"),
    )
