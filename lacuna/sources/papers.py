"""Formatted search listings as paper records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "url", "abstract", "id", "source", "date", "authors")


def parse_papers(listings: DataFrame, column: str = "output") -> DataFrame:
    """Numbered entries, one row each: the other columns, place, title, url, abstract, id, source, date, authors (null where absent).

    A line is a link, a doi, a quoted abstract, an id · source · date line, or else, the first time, the authors."""
    text = F.regexp_replace(F.col(column), "\u001b\\[[0-9;]*m", "")
    entry = F.posexplode(F.split(text, r"\n(?=\s+\d+\.\s)")).alias("place", "entry")
    rows = listings.select(*[c for c in listings.columns if c != column], entry)
    lines = F.filter(F.transform(F.split(F.trim(F.regexp_replace("entry", r"^\s+|\s+$", "")), "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    rows = rows.withColumn("lines", lines).withColumn("title", F.trim(F.regexp_extract(F.get("lines", F.lit(0)), r"^\d+\.\s+(.+)", 1))).where("title <> ''")
    rest = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    kind = lambda s: F.when(s.startswith("https://") | s.startswith("doi:"), "url").when(s.startswith('"'), "abstract").when(F.contains(s, F.lit("·")), "id").otherwise("authors")
    of = lambda k: F.filter(rest, lambda s: kind(s) == k)
    link = F.get(of("url"), F.lit(0))
    parts = F.transform(F.split(F.get(F.reverse(of("id")), F.lit(0)), "·"), lambda s: F.trim(s))
    out = rows.withColumn("url", F.when(link.startswith("doi:"), F.concat(F.lit("https://doi.org/"), F.substring(link, F.lit(5), F.length(link)))).otherwise(link))
    out = out.withColumn("abstract", F.regexp_replace(F.get(F.reverse(of("abstract")), F.lit(0)), '^"+|"+$', ""))
    for i, name in enumerate(("id", "source", "date")):
        out = out.withColumn(name, F.get(parts, F.lit(i)))
    return out.withColumn("authors", F.get(of("authors"), F.lit(0))).drop("entry", "lines")


def result_count(output: Column, parsed: Column) -> Column:
    """The number that a listing states, or else the number of its entries."""
    stated = F.regexp_replace(F.regexp_extract(output, r"(?i)([\d,]+)\s+(?:results|papers|hits)", 1), ",", "")
    return F.coalesce(F.nullif(stated, F.lit("")).cast("long"), parsed.cast("long"))
