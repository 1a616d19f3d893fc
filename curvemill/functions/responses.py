"""Text that a language model gets and returns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mark that opens and closes a Markdown code block, with the language that it may name.
MARK, LANGUAGE = "```", "json"


def prompt(x_low: Column, x_high: Column, x_scale: Column, y_low: Column, y_high: Column) -> Column:
    """What to ask for a chart with these axes."""
    text = (
        "Read every data series from the chart image. The plot area spans x from %s to %s (%s scale) and y from %s to %s.\n"
        'Answer with one JSON object only: {"series": [{"label": "<name>", "x": [<numbers>], "y": [<numbers>]}]}'
    )
    return F.format_string(text, *(c.cast("string") for c in (x_low, x_high, x_scale, y_low, y_high)))


def without_fence(text: Column) -> Column:
    """What stands in a Markdown code fence, or the text as it is."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    fenced = (F.length(bare) >= 2 * len(MARK)) & bare.startswith(MARK) & bare.endswith(MARK)
    inner = F.substring(bare, F.lit(len(MARK) + 1), F.length(bare) - 2 * len(MARK))
    named = F.when(inner.startswith(LANGUAGE), F.substring(inner, F.lit(len(LANGUAGE) + 1), F.length(inner))).otherwise(inner)
    return F.when(fenced, F.trim(named)).otherwise(text)


def parsed_series(response: Column) -> Column:
    """The usable series of a response: equal, positive numbers of x and y, all of them numbers (quoted or not). No JSON gives none.

    Each entry is read by itself, so that one that is no series takes no other with it; a missing label is empty.
    """
    entries = F.from_json(without_fence(response), "struct<series:array<string>>")["series"]
    read = F.transform(entries, lambda e: F.from_json(e, "struct<label:string,x:array<string>,y:array<string>>"))
    numbers = lambda values: F.transform(values, lambda v: v.try_cast("double"))
    typed = F.transform(read, lambda s: F.struct(F.coalesce(s["label"], F.lit("")).alias("label"), numbers(s["x"]).alias("x"), numbers(s["y"]).alias("y")))
    usable = F.filter(typed, lambda s: (F.size(s["x"]) > 0) & (F.size(s["x"]) == F.size(s["y"])) & ~F.exists(s["x"], lambda v: v.isNull()) & ~F.exists(s["y"], lambda v: v.isNull()))
    return F.coalesce(usable, F.expr("cast(array() as array<struct<label:string,x:array<double>,y:array<double>>>)"))
