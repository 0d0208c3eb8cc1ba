"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Sources by code point, null last, take weights 5, 2, 1 in turn and share the
budget (all words, by default).  A target stops at ``most`` times its source and
the excess goes to the others by weight until none is above.  Documents of a
source are shuffled (by MD5 of seed, id and text) and queue up, pass after pass, at
most ``most`` times.  An entry of the queue has a virtual finish time: its source's
words through its end, divided by the source's target.  All entries are sorted by
finish time over the whole cluster and served in that order until the budget is
used up; the entry that is served then is cut there.

Cumulative sums are two-level: sums of 4096 shuffle cells of each source first,
then inside a cell; and sums of the ranges of the sorted queue first, then inside a
range.  So neither a source with a third of all rows nor the queue is in one task;
only tables with a row a source or a range are.

Null texts have size 0: they are in the result, but nothing of them is taken.  A null
source is a source.  Every row is a document of its own, whether its id is null,
repeated or not, and lies in the cell of its id and text: only rows equal in both share one
for certain.
Very long texts are counted whole.  An empty table gives none, and columns with names of
this module's own don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, numbered, unused, written

WEIGHTS = (5, 2, 1)
MOST = 3
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, budget: int | None = None) -> DataFrame:
    """(source, source_size, target, budget) from (source, source_size), one row a source.

    Filling all sources at their weights, source i is full at level
    ``most * size / weight``; in the order of these levels the first that isn't
    reached, by what is left over the weights left, is the level of all after it.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(place) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), turn.cast("int") + 1)
    rows = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.lit(budget).cast("long") if budget is not None else F.sum("source_size").over(whole)
    rows = rows.select("*", total.alias("total"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("full"), (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left"))
    level = F.when(F.col("weight") * (F.col("total") - F.col("full")) < F.col("cap") * F.col("left"), (F.col("total") - F.col("full")) / F.col("left"))
    rows = rows.select("source", "source_size", "weight", "cap", "total", level.alias("level"))
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.first("level", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.col("cap").cast("double"))).alias("target"), F.col("total").alias("budget"))


def shuffled(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """A row's place in its source's shuffled order: by id and text, so that rows without id or of one id are spread too."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def queued(sized: DataFrame, scratch: Scratch, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, budget: int | None = None) -> DataFrame:
    """Rows (row, doc_id, source, size, shuffle) with source_size, target, budget and start: the source's words before them in a pass."""
    rows = sized.withColumn("cell", F.substring("shuffle", 1, 3))
    cells = scratch.written(rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")), "cells")
    aims = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights=weights, most=most, budget=budget)
    so_far = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.select("source", "cell", F.coalesce(F.sum("cell_size").over(so_far), F.lit(0)).alias("ahead"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    aimed = placed.join(aims.withColumnRenamed("source", "s"), same("source", "s")).drop("s").withColumnsRenamed({"source": "of_source", "cell": "of_cell"})
    within = Window.partitionBy("source", "cell").orderBy("shuffle", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("inside", F.sum("size").over(within)).join(aimed, same("source", "of_source") & (F.col("cell") == F.col("of_cell")))
    return out.select("row", "doc_id", "source", "size", "source_size", "target", "budget", (F.col("ahead") + F.col("inside") - F.col("size")).alias("start"))


def served(queue: DataFrame, scratch: Scratch, rows: int, most: int = MOST) -> DataFrame:
    """(of_row, taken): the words that the budget takes of each row's entries, in the order of their virtual finish times."""
    passes = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass")
    entries = queue.where("size > 0 and target > 0").select("row", "source", "size", "target", "budget", "start", "source_size", passes)
    entries = entries.withColumn("place", F.col("source_size") * F.col("pass") + F.col("start"))
    entries = entries.select("row", "source", "size", "budget", "place", ((F.col("place") + F.col("size")) / F.col("target")).alias("finish"))
    parts = max(int(queue.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows * most // 4_000_000))
    # the ranges are bounded by a sample, so they are written: a range is one and the same for both sums
    ranged = scratch.written(entries.repartitionByRange(parts, "finish").withColumn("range", F.spark_partition_id()), "ranged")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ahead = ranged.groupBy("range").agg(F.sum("size").alias("n")).select(F.col("range").alias("of_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ahead = scratch.written(ahead, "ranges")
    within = Window.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = ranged.join(ahead, F.col("range") == F.col("of_range")).where("ahead < budget").withColumn("used", F.col("ahead") + F.sum("size").over(within) - F.col("size"))
    used = used.where("used < budget").select("row", F.least(F.col("size"), F.col("budget") - F.col("used")).alias("taken"))
    return used.groupBy(F.col("row").alias("of_row")).agg(F.sum("taken").alias("taken"))


def _mixed(rows: DataFrame, columns: dict[str, str], scratch: Scratch, **options) -> tuple[DataFrame, DataFrame]:
    """The queue of written, numbered and sized rows, and what of it is taken."""
    sized = rows.select(*(F.col(c).alias(n) for n, c in columns.items()))
    queue = scratch.written(queued(sized, scratch, **options), "queue")
    return queue, served(queue, scratch, rows.count(), options.get("most", MOST))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    scratch = Scratch(docs.sparkSession)
    rows, _ = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), shuffled(F.col(id_col), F.col(text_col), seed).alias("shuffle")))
    names = ("row", "doc_id", "source", "size", "shuffle")
    queue, taken = _mixed(scratch.written(rows, "sized"), dict(zip(names, names)), scratch, **options)
    out = written(queue.join(taken.hint("merge"), F.col("row") == F.col("of_row"), "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), "mix")
    scratch.clear()
    return out


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **options) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them; the one that the budget cuts counts if half of it is taken."""
    scratch = Scratch(docs.sparkSession)
    rows, row = numbered(docs)
    size, place, key, count = (unused(rows, name) for name in ("size", "shuffle", "of_row", "times"))
    rows = written(rows.withColumns({size: word_count(F.col(text_col)), place: shuffled(F.col(id_col), F.col(text_col), seed)}), "sized")
    queue, taken = _mixed(rows, {"row": row, "doc_id": id_col, "source": source_col, "size": size, "shuffle": place}, scratch, **options)
    # merged at every size: a table of row numbers is much smaller on disk than in memory
    taken = taken.join(queue.select("row", "size").hint("merge"), F.col("of_row") == F.col("row"))
    times = F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2)).cast("int")
    times = written(taken.select(F.col("of_row").alias(key), times.alias(count)).where(F.col(count) > 0), "times")
    scratch.clear()
    out = rows.join(times.hint("merge"), F.col(row) == F.col(key)).withColumn(count, F.explode(F.sequence(F.lit(1), F.col(count))))
    return out.select(*(rows[c] for c in docs.columns))
