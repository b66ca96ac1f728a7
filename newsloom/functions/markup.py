"""Attributes and meta contents of page markup by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = "[\"']([^\"']*)"


def first_attribute(html: Column, tag: str, name: str) -> Column:
    """The value of an attribute on the first tag that has it, else null."""
    return F.nullif(F.regexp_extract(html, rf"(?i)<{tag}[^>]+{name}={_QUOTED}", 1), F.lit(""))


def meta_content(html: Column, names: list[str]) -> Column:
    """Content of the first of these meta names or properties, with the attributes in either order."""
    found = []
    for n in names:
        found.append(F.nullif(F.regexp_extract(html, rf"(?i)<meta[^>]+(?:name|property)=[\"']{n}[\"'][^>]*content={_QUOTED}", 1), F.lit("")))
        found.append(F.nullif(F.regexp_extract(html, rf"(?i)<meta[^>]+content={_QUOTED}[\"'][^>]*(?:name|property)=[\"']{n}[\"']", 1), F.lit("")))
    return F.coalesce(*found)


def lead_image(html: Column, description: Column | None = None) -> Column:
    """og:image, then twitter:image, then the first picture of the description."""
    first = meta_content(html, ["og:image", "twitter:image"])
    return first if description is None else F.coalesce(first, first_attribute(description, "img", "src"))
