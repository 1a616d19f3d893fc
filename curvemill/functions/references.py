"""Figure references, identifiers, file names and signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value, the notation of a reference: an optional word, digits, an optional panel letter, bare, in brackets or after an underscore.
FIGURE = r"(?i)^(?:fig(?:ure)?\.?\s+)?(\d+)\s*(?:[(_]?\s*([a-zA-Z])\)?)?$"


def figure_reference(raw: Column) -> Column:
    """struct(number, panel) of a figure's name; null if it isn't one. The panel is lower case, or null."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    parts = F.struct(F.regexp_extract(text, FIGURE, 1).alias("number"), F.nullif(F.lower(F.regexp_extract(text, FIGURE, 2)), F.lit("")).alias("panel"))
    return F.when(text.rlike(FIGURE), parts)


def bare_doi(doi: Column, lower: bool = False) -> Column:
    """Without the resolver's address; null for an empty one."""
    bare = F.nullif(F.regexp_replace(doi, r"^https://doi\.org/", ""), F.lit(""))
    return F.lower(bare) if lower else bare


def first_filled(*choices: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in choices))


def work_license(primary: Column, locations: Column) -> Column:
    """The primary location's license, or the first filled one of the locations' array of struct(license)."""
    return F.coalesce(F.nullif(primary, F.lit("")), F.get(F.filter(F.transform(locations, lambda x: x["license"]), lambda x: x != ""), F.lit(0)))


def is_pdf(content: Column) -> Column:
    """Whether bytes begin with the PDF signature, after white space."""
    return F.startswith(F.regexp_replace(F.decode(content, "ISO-8859-1"), r"^[ \t\n\r\x0b\f]+", ""), F.lit("%PDF"))


def image_name(page: Column, source: Column, index: Column) -> Column:
    """p01_embedded_0.jpg and the like; a page's render is a png."""
    return F.format_string("p%02d_%s_%d.%s", page.cast("int"), source, index.cast("int"), F.when(source == "page_render", "png").otherwise("jpg"))


def image_path(name: Column, root: str, default_dir: str) -> Column:
    """A path with a slash is taken from root, a bare name from the default folder."""
    return F.when(F.contains(name, F.lit("/")), F.concat(F.lit(f"{root}/"), name)).otherwise(F.concat(F.lit(f"{root}/{default_dir}/"), name))


def series_label(prop: Column, unit: Column) -> Column:
    """"prop (unit)", or prop where the unit is empty."""
    prop, unit = F.coalesce(prop, F.lit("")), F.coalesce(unit, F.lit(""))
    return F.when(unit != "", F.concat(prop, F.lit(" ("), unit, F.lit(")"))).otherwise(prop)
