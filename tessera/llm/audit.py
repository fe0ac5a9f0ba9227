"""How five quality filters interact: which documents each removes, alone and in every order.

Built-in functions alone turn a text into a mask of the filters it fails. A text leaves its rows as a
digest, so that only short rows are shuffled; the smallest doc_id of a digest says which rows repeat it.
All 120 orders follow from 32 counts per part."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Failure conditions, a bit each: few words, few distinct words, capitals, markup, repeats.
FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    sizes = F.transform(F.array(F.array_remove(F.split(text, SPACE), "")), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    chars = F.length(text)
    capitals = chars - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    # one struct, so that the text is cut into words once
    return F.transform(
        F.array(sizes),
        lambda s: F.when(s["words"] < 200, 1).otherwise(0)
        + F.when(100 * s["distinct"].cast("long") < 50 * s["words"].cast("long"), 2).otherwise(0)
        + F.when(100 * capitals.cast("long") > 2 * chars.cast("long"), 4).otherwise(0)
        + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0),
    )[0]


def failure_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents of a part by the set of filters they fail, and how many
    of them are labelled good (quality 1) or toxic (toxic 1; any of a document's label rows counts).

    A row without an id has no smaller one and no label: it repeats nothing, and nothing repeats it. Rows
    that repeat an id with the same text pass or fail together. An empty table has no cells."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text_mask(F.col(text_col)).alias("mask"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"),
    )
    rows = written(rows, "masks")  # texts are read once
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # rows without an id would all meet in one task of the join
    named = rows.where("id is not null").join(marks, "id", "left").select("id", "part", "mask", "digest", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    nameless = rows.where("id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")).groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    # copies of a text are counted per part and label before they meet: a group of copies is a few rows
    kind = ["digest", "part", "mask", "good", "toxic"]
    counted = named.groupBy("id", *kind).agg(F.count("*").alias("n")).groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    smallest = counted.groupBy("digest").agg(F.min("first.id").alias("smallest"))
    first = F.when(F.col("first.id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    split = counted.join(smallest, "digest").select("part", "good", "toxic", F.explode(F.array(F.struct("mask", first.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - first).alias("n")))).alias("c"))
    every = split.select("part", "good", "toxic", "c.mask", "c.n").where("n > 0").unionByName(nameless)
    cells = every.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    cells = written(cells, "cells")
    drop_written(rows)
    return cells


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before, bit of the step's filter) for all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for i, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            out.append(("".join(order), i + 1, before, bit))
            before |= bit
    return out


def interactions(cells: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from the cells of ``failure_cells``: documents
    that stay after the step (kept), that it removes (removed), that fail it but went before (redundant),
    that fail it alone (unique_fails), labelled good or toxic ones that it removes, and what its
    filter removes over all orders (shapley): a document that fails k filters falls to each in 120 / k."""
    full = (1 << len(FILTERS)) - 1
    at = lambda column: F.array(*[F.sum(F.when(F.col("mask") == m, F.col(column)).otherwise(0)) for m in range(full + 1)])
    parts = cells.groupBy("part").agg(at("n").alias("n"), at("good").alias("good"), at("toxic").alias("toxic"))
    table = F.expr("from_json('" + str([list(s) for s in steps()]).replace("'", '"') + "', 'array<array<string>>')")
    rows = parts.select("part", "n", "good", "toxic", F.explode(table).alias("s"))
    rows = rows.select("part", "n", "good", "toxic", F.col("s")[0].alias("filter_order"), F.col("s")[1].cast("int").alias("step"), F.col("s")[2].cast("int").alias("before"), F.col("s")[3].cast("int").alias("bit"))
    masks = F.sequence(F.lit(0), F.lit(full))

    def total(column: str, where, weight=lambda m: F.lit(1)) -> Column:
        return F.aggregate(masks, F.lit(0).cast("long"), lambda a, m: a + F.when(where(m), F.col(column)[m] * weight(m)).otherwise(0))

    before, bit = F.col("before"), F.col("bit")
    falls = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(bit) != 0)
    orders = len(list(permutations(FILTERS)))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total("n", falls).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(bit) != 0)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", falls).alias("good_lost"),
        total("toxic", falls).alias("toxic_lost"),
        total("n", lambda m: m.bitwiseAND(bit) != 0, lambda m: (F.lit(orders) / F.bit_count(m)).cast("long")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``interactions`` of the cells of ``docs``; parts are the values of ``part_col`` (null: empty text)."""
    return interactions(failure_cells(docs, labels, id_col, text_col, part_col))
