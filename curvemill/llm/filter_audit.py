"""Audit of how text filters interact: what each one removes in every order in which they can be applied.

Each document becomes a mask of the filters that it fails. Masks are counted by part (a group of at most 32 cells of
five filters), and the rest works on these cells alone: each one folds over the array of all 120 orders (a literal that
goes to the tasks with the plan) by ``transform`` and ``aggregate`` and gives 600 structs, an order's steps one after
another, weighted by the cell's documents. A part's cells are merged by elementwise sums.

Filters (a document fails): A under 200 words; B fewer than half of its words distinct; C over 2 % capital letters;
D a character of ``#$%&*|``; E its text is that of a row with a smaller doc_id. Words are runs of anything but ASCII
white space, case counts.

Only E looks at other rows: texts are grouped by their SHA-256, counts and least ids are combined before the shuffle,
and rows find their group's least id by a join on digest and doc_id, which no group of copies can make hot.

A null text is empty (it fails A, and E after another empty one); a null source is an empty part, a null doc_id counts
as larger than every other and has no labels; repeated rows with one doc_id don't make each other fail E. Of several
labels of a doc_id any 1 counts. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill.llm._common import staged

FILTERS = "ABCDE"
#: Every order of the filters, as their numbers.
ORDERS = [list(p) for p in permutations(range(len(FILTERS)))]
#: Least words, least percent of distinct words, most percent of capitals, characters of markup.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _failed(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text fails."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n_words, capitals = F.size(words), F.regexp_count(text, F.lit("[A-Z]"))
    tests = (n_words < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n_words, 100 * capitals.cast("long") > MAX_CAPITALS * F.length(text), text.rlike(MARKS))
    total = F.lit(0)
    for bit, test in enumerate(tests):
        total = total + F.when(test, 1 << bit).otherwise(0)
    return total


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row (part, mask, good, toxic) for each of documents (doc_id, text, source): bit i of mask says that it fails filter i; good and toxic are 1 or 0, from labels (doc_id, quality, toxic)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), _failed(text).alias("failed"), F.unhex(F.sha2(text, 256)).alias("digest"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")))
    # rows without an id match nothing; a number of their own keeps them from meeting in one task
    known = plain.withColumn("known", F.col("doc_id").isNotNull()).withColumn("at", F.coalesce("doc_id", F.xxhash64("digest", "part")))
    marked = known.join(marks.withColumn("is", F.lit(True)), (F.col("at") == F.col("labelled")) & (F.col("known") == F.col("is")), "left")
    rows = staged(marked.select("doc_id", "part", "failed", "digest", *(F.coalesce(F.col(c), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic")))), "masks")
    first = rows.groupBy(F.col("digest").alias("same")).agg(F.min("doc_id").alias("least"))
    found = rows.join(first, (F.col("digest") == F.col("same")) & F.col("doc_id").eqNullSafe(F.col("least")), "left")
    return found.select("part", (F.col("failed") + F.when(F.col("same").isNull(), 1 << 4).otherwise(0)).alias("mask"), "good", "toxic")


def _folded(cell: Column, orders: Column) -> Column:
    """What a cell (mask, n, good, toxic) adds to each step of each order: 600 structs of COUNTS."""

    def one(order: Column) -> Column:
        start = F.struct(F.lit(True).alias("here"), F.expr(f"cast(array() as array<struct<{', '.join(f'{c}:bigint' for c in COUNTS)}>>)").alias("steps"))

        def step(state: Column, which: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1), which)
            fails, here = cell["mask"].bitwiseAND(bit) != 0, state["here"]
            taken = lambda test, what: F.when(test, cell[what]).otherwise(F.lit(0).cast("long"))
            added = F.struct(
                taken(here & ~fails, "n").alias("kept"), taken(here & fails, "n").alias("removed"), taken(~here & fails, "n").alias("redundant"),
                taken(cell["mask"] == bit, "n").alias("unique_fails"), taken(here & fails, "good").alias("good_lost"), taken(here & fails, "toxic").alias("toxic_lost"),
            )
            return F.struct((here & ~fails).alias("here"), F.concat(state["steps"], F.array(added)).alias("steps"))

        return F.aggregate(order, start, step)["steps"]

    return F.flatten(F.transform(orders, one))


def audit(found: DataFrame) -> DataFrame:
    """Of masks' rows: for each part, order and step (1 to 5) the documents that the step keeps and removes, and what else the module says."""
    cells = found.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32
    orders = F.lit(ORDERS)
    zeros = F.array_repeat(F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTS)), len(ORDERS) * len(FILTERS))
    both = lambda a, b: F.struct(*((a[c] + b[c]).alias(c) for c in COUNTS))
    sums = parts.select("part", F.aggregate("cells", zeros, lambda total, cell: F.zip_with(total, _folded(cell, orders), both)).alias("sums"))
    which = F.flatten(orders)
    removed = lambda f: F.aggregate(F.zip_with("sums", which, lambda s, w: F.when(w == f, s["removed"]).otherwise(0)), F.lit(0).cast("long"), lambda t, v: t + v)
    # written down once for each part, not for each of its rows
    ready = sums.withColumn("shares", F.transform(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)), removed))
    names = F.lit(["".join(FILTERS[k] for k in order) for order in ORDERS])
    at = lambda divided: F.get(divided, F.floor(F.col("i") / len(FILTERS)).cast("int"))
    rows = ready.select("part", "shares", F.posexplode("sums").alias("i", "s"))
    return rows.select("part", at(names).alias("filter_order"), (F.col("i") % len(FILTERS) + 1).alias("step"), "s.*", F.get("shares", F.get(which, F.col("i"))).alias("shapley"))
