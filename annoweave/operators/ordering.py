"""Numbering, batching and context windows over ordered records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annoweave.schemas import CONTEXT_LINES

#: Ordinals of one numbering range, and rows that a task sorts, about.
RANGE, TASK_ROWS = 1 << 16, 1 << 19
#: Ranges whose counts are summed up together.
FAN = 1 << 14
#: Lines of a context chunk, and ordinals of the ranges that are looked at as a whole for one.
CHUNK, REACH = 4096, 512


def _starts(counts: DataFrame, keys: list[str], span: int) -> DataFrame:
    """Add __before, the sum of count over all smaller __range, to (keys..., __range, count).

    span is the number of ranges between the least and the greatest. Ranges are summed up
    in groups of FAN, those in groups of FAN again, until few enough are left for one
    window; so no task sees more than FAN rows of one table, however sparse the ranges are.
    """
    before = lambda *by: F.coalesce(F.sum("count").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if span <= FAN:
        return counts.withColumn("__before", before(*keys))
    grouped = counts.withColumn("__group", F.floor(F.col("__range") / F.lit(FAN)))
    sums = grouped.groupBy(*keys, F.col("__group").alias("__range")).agg(F.sum("count").alias("count"))
    outer = _starts(sums, keys, span // FAN + 1).select(*keys, F.col("__range").alias("__group"), F.col("__before").alias("__outer"))
    inner = grouped.withColumn("__inner", before(*keys, "__group")).join(outer, [*keys, "__group"])
    return inner.select(*keys, "__range", "count", (F.col("__inner") + F.col("__outer")).alias("__before"))


def dense_number(df: DataFrame, ordinal: str, name: str, width: int = RANGE, within: list[str] | None = None) -> DataFrame:
    """Number rows from 1 by an integer ordinal, without bringing them all together.

    Rows are cut into ranges of the ordinal; each range is numbered by itself and
    starts after the count of the ranges before it. Reads the ordinal once beforehand,
    for its least and greatest value and the number of rows: ranges are dealt to as many tasks
    as that asks for, so that what one of them sorts doesn't grow with the table.
    """
    keys = within or []
    ends = df.agg(F.floor(F.min(ordinal) / F.lit(width)), F.floor(F.max(ordinal) / F.lit(width)), F.count(F.lit(1))).first()
    span = 1 if ends[0] is None else int(ends[1]) - int(ends[0]) + 1
    ranged = df.withColumn("__range", F.floor(F.col(ordinal) / F.lit(width)))
    starts = _starts(ranged.groupBy(*keys, "__range").count(), keys, span).drop("count")
    own = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(ordinal))
    if not keys and span <= FAN:
        starts = F.broadcast(starts)  # a row a range
    dealt = ranged.repartition(tasks(df, ends[2]), *keys, "__range")
    return dealt.withColumn("__own", own).join(starts, [*keys, "__range"]).withColumn(name, F.col("__before") + F.col("__own")).drop("__range", "__own", "__before")


def tasks(df: DataFrame, rows: int) -> int:
    """Tasks that so many rows are dealt to: as many as the session asks for, more for large tables."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def sorted_by(df: DataFrame, *order: str | Column) -> DataFrame:
    """df in a stated order over all its partitions, of which there are as many as its rows ask for. Counts the rows once beforehand."""
    n = tasks(df, df.count())
    if n == tasks(df, 0):
        return df.orderBy(*order)
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def record_id(number: Column, prefix: str = "eng_") -> Column:
    return F.format_string(prefix + "%06d", number)


def record_number(record: Column) -> Column:
    """The number at the end of a record id, by which records are ordered; ids as text are not, from a million on."""
    return F.regexp_extract(record, "([0-9]+)$", 1).try_cast("long")


def batch_number(number: Column, size: int) -> Column:
    """Batches of `size` by a number from 1."""
    if size < 1:
        raise ValueError("batch size must be positive")
    return (F.floor((number - 1) / size) + 1).cast("long")


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order."""
    if n < 1:
        raise ValueError("limit must be positive")
    return df.orderBy(*order).limit(n)


def context_windows(lines: DataFrame, keys: list[str], ordinal: str, item: Column, size: int = CONTEXT_LINES) -> DataFrame:
    """Add context_before and context_after: up to `size` items on either side, in order."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    return lines.withColumn("context_before", F.collect_list(item).over(w.rowsBetween(-size, -1))).withColumn(
        "context_after", F.collect_list(item).over(w.rowsBetween(1, size))
    )


def contexts_at(lines: DataFrame, hits: DataFrame, keys: list[str], ordinal: str, item: Column, size: int = CONTEXT_LINES, chunk: int = CHUNK, reach: int = REACH) -> DataFrame:
    """The lines named by hits(keys..., ordinal), each with context_before and context_after as in context_windows.

    Chunks and halos: a line's place among its keys' lines comes from the counts of ranges
    of the ordinal; only ranges within `size` places of one that holds a hit are kept. Places
    are cut into chunks; a line within `size` of a chunk's end is copied to the neighbour,
    and only chunks with a hit get windows. So a task holds a chunk and its halo however many lines
    have the same keys, and lines far from any hit are counted and no more. An ordinal
    is an integer, once for the same keys.
    """
    if chunk < size:
        raise ValueError("a chunk must be as long as the context")
    in_range = F.floor(F.col(ordinal) / F.lit(reach)).alias("__range")
    ends = lines.agg(F.floor(F.min(ordinal) / F.lit(reach)), F.floor(F.max(ordinal) / F.lit(reach))).first()
    span = 1 if ends[0] is None else int(ends[1]) - int(ends[0]) + 1
    starts = _starts(lines.groupBy(*keys, in_range).count(), keys, span)
    wanted = hits.groupBy(*keys, in_range).agg(F.collect_set(ordinal).alias("__hits"))  # `reach` ordinals at most
    starts = starts.join(wanted, [*keys, "__range"], "left")
    blocks = lambda first, last: F.explode(F.sequence(F.floor((F.col("__before") - first) / chunk), F.floor((F.col("__before") + F.col("count") - 1 + last) / chunk))).alias("__block")
    needed = starts.filter(F.col("__hits").isNotNull()).select(*keys, blocks(size, size)).distinct()
    held = starts.select(*keys, "__range", "__before", "__hits", blocks(0, 0))
    near = held.join(needed, [*keys, "__block"], "left_semi").drop("__block").distinct()
    kept = lines.withColumn("__range", in_range).join(near, [*keys, "__range"])
    place = F.col("__before") + F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(ordinal)) - 1
    placed = kept.withColumns({"__place": place, "__hit": F.coalesce(F.array_contains("__hits", F.col(ordinal)), F.lit(False))}).drop("__range", "__before", "__hits")
    own = F.floor(F.col("__place") / F.lit(chunk))
    within = F.col("__place") - own * chunk
    copies = F.filter(F.array(own, F.when(within < size, own - 1), F.when(within >= chunk - size, own + 1)), lambda c: c.isNotNull())
    dealt = placed.withColumns({"__own": own, "__chunk": F.explode(copies)})
    with_hit = placed.filter("__hit").select(*keys, own.alias("__chunk")).distinct()
    w = Window.partitionBy(*keys, "__chunk").orderBy("__place")
    found = dealt.join(with_hit, [*keys, "__chunk"], "left_semi").withColumns(
        {"context_before": F.collect_list(item).over(w.rowsBetween(-size, -1)), "context_after": F.collect_list(item).over(w.rowsBetween(1, size))}
    )
    return found.filter(F.col("__hit") & (F.col("__own") == F.col("__chunk"))).drop("__place", "__hit", "__own", "__chunk")


def context_missing(before: Column, after: Column) -> Column:
    return (F.size(before) == 0) & (F.size(after) == 0)


def last_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of rows with equal keys, the last in order. Partial aggregates; no sort, no group in memory."""
    names = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("__last")).select(*keys, *[F.col(f"__last.{c}").alias(c) for c in names])


def top_counts(df: DataFrame, key: str, n: int, name: str = "n") -> DataFrame:
    """The n commonest values, ties in order of value."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), key).limit(n)
