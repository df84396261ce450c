"""Operators on interval tables: joins, merging, depth, gaps, nearest neighbours, tiles.

Tables have the columns ``chrom, start, end`` (closed, 1-based) and any others. Joins on
overlap deal both sides to bins of positions and join on (contig, bin), so a contig is never
one task's business and no pair is made twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _binned(df: DataFrame, bin_size: int, left: int = 0, right: int = 0) -> DataFrame:
    low, high = F.least("start", "end") - left, F.greatest("start", "end") + right
    low, high = (F.floor(x / bin_size).cast("long") for x in (low, high))
    return df.withColumn("__low", low).withColumn("__bin", F.explode(F.sequence(low, high)))


def overlap_join(a: DataFrame, b: DataFrame, bin_size: int, left: int = 0, right: int = 0, how: str = "inner") -> DataFrame:
    """Pairs of overlapping rows; ``b`` may be extended by ``left`` and ``right``.

    Columns of ``b`` get the prefix ``b_``. A pair is made in the bin where the later of the
    two begins. ``how``: inner, left_semi or left_anti; for the last two ``a`` keeps its rows
    whole by a number of its own, so nothing needs a key.
    """
    if how in ("left_semi", "left_anti"):
        b_ = b.select("chrom", "start", "end").distinct()
        binned = _binned(a.withColumn("__row", F.struct(*a.columns)), bin_size)
        met = _pairs(binned, _binned(b_, bin_size, left, right), left, right)
        hit = met.select("__row").distinct()
        keyed = a.withColumn("__row", F.struct(*a.columns))
        return keyed.join(hit, keyed["__row"].eqNullSafe(hit["__row"]), how).select(*a.columns)
    met = _pairs(_binned(a, bin_size), _binned(b, bin_size, left, right), left, right)
    return met.select(*a.columns, *(F.col(f"b_{c}") for c in b.columns))


def _pairs(a: DataFrame, b: DataFrame, left: int, right: int) -> DataFrame:
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    s1, e1 = F.least("start", "end"), F.greatest("start", "end")
    s2, e2 = F.least("b_start", "b_end") - left, F.greatest("b_start", "b_end") + right
    first = F.col("__bin") == F.greatest("__low", "b___low")
    return a.join(b, (F.col("chrom") == F.col("b_chrom")) & (F.col("__bin") == F.col("b___bin")) & first & (s1 <= e2) & (s2 <= e1))


def first_overlap(a: DataFrame, b: DataFrame, bin_size: int, order: list[str], **ext: int) -> DataFrame:
    """Each row of ``a`` (by all its columns) with the first row of ``b`` that overlaps it."""
    met = overlap_join(a, b, bin_size, **ext)
    rank = F.row_number().over(Window.partitionBy(*a.columns).orderBy(*(f"b_{c}" for c in order)))
    return met.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def in_regions(df: DataFrame, regions: DataFrame, mode: str = "overlap", extend: int = 0) -> DataFrame:
    """Rows of ``df`` that meet a user region (null ends: a whole contig).

    ``mode``: overlap, contained, or point (column ``pos``). The list of regions is the user's
    own; the planner broadcasts it if it is below its threshold, else both sides are shuffled
    by contig.
    """
    r = regions.select(F.col("chrom").alias("r_chrom"), F.coalesce("start", F.lit(1)).alias("r_start"), F.coalesce("end", F.lit(1 << 62)).alias("r_end"))
    inside = {
        "overlap": lambda: (F.col("start") <= F.col("r_end") + extend) & (F.col("end") >= F.col("r_start") - extend),
        "contained": lambda: (F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end")),
        "point": lambda: F.col("pos").between(F.col("r_start"), F.col("r_end")),
    }[mode]()
    return df.join(r, (F.col("chrom") == F.col("r_chrom")) & inside, "left_semi")


def merge(df: DataFrame, keys: list[str] = ["chrom"], gap: int = 0, extra: list[Column] = []) -> DataFrame:  # noqa: B006
    """Union of overlapping intervals: a new one begins past all earlier ends (plus ``gap``)."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") > before + gap).cast("int"), F.lit(1))
    island = F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("__opens", opens).withColumn("__island", island)
    return rows.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), *extra).drop("__island")


def merge_tiled(df: DataFrame, tile: int, keys: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """``merge`` for contigs of any number of rows: first within tiles, then what is left.

    Interval starts are dealt to tiles; the merged pieces of all tiles, of which a tile has few,
    are merged once more per contig.
    """
    tiled = merge(df.withColumn("__tile", F.floor(F.col("start") / tile)), [*keys, "__tile"])
    return merge(tiled.withColumnRenamed("n", "__n"), keys, extra=[F.sum("__n").alias("members")]).drop("n").withColumnRenamed("members", "n")


def depth(df: DataFrame, keys: list[str] = ["chrom"], tile: int = 1_000_000) -> DataFrame:  # noqa: B006
    """(start, end, depth) runs of positions that the same number of intervals cover.

    Two events an interval instead of one row a position: +1 at its start, -1 past its end.
    They are added up by tiles first, so no task sorts a contig.
    """
    events = df.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("x"))
    steps = events.groupBy(*keys, F.col("x.pos").alias("start")).agg(F.sum("x.d").alias("d"))
    steps = steps.withColumn("__tile", F.floor(F.col("start") / tile))
    tiles_ = steps.groupBy(*keys, "__tile").agg(F.sum("d").alias("__sum"), F.min("start").alias("__first"))
    across = Window.partitionBy(*keys).orderBy("__tile")
    before = F.coalesce(F.sum("__sum").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tiles_ = tiles_.select(*keys, "__tile", before.alias("__before"), F.lead("__first").over(across).alias("__next"))
    inside = Window.partitionBy(*keys, "__tile").orderBy("start")
    runs = steps.join(tiles_, [*keys, "__tile"]).withColumn("depth", F.col("__before") + F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("end", F.coalesce(F.lead("start").over(inside), F.col("__next")) - 1)
    return runs.filter("depth > 0").select(*keys, "start", "end", "depth")


def gaps(df: DataFrame, keys: list[str] = ["chrom"], least: int = 2, tile: int = 1_000_000) -> DataFrame:  # noqa: B006
    """Uncovered runs between the merged intervals, of at least ``least`` positions."""
    order = Window.partitionBy(*keys).orderBy("start")
    islands = merge_tiled(df, tile, keys)
    between = islands.select(*keys, (F.lag("end").over(order) + 1).alias("gap_start"), (F.col("start") - 1).alias("gap_end"))
    return between.filter(F.col("gap_end") - F.col("gap_start") + 1 >= least).select(*keys, F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))


def nearest(df: DataFrame, keys: list[str], pos: str, ident: str) -> DataFrame:
    """Each row's nearest other row of its key by position; of equally near ones the earlier.

    In position order the nearest one is a neighbour, so two lookups do.
    """
    order = Window.partitionBy(*keys).orderBy(pos, ident)
    rows = df.select("*", F.lag(F.struct(pos, ident)).over(order).alias("__p"), F.lead(F.struct(pos, ident)).over(order).alias("__n"))
    back, ahead = F.col(pos) - F.col(f"__p.{pos}"), F.col(f"__n.{pos}") - F.col(pos)
    use_back = F.col("__n").isNull() | (F.col("__p").isNotNull() & (back <= ahead))
    near, far = F.when(use_back, F.col(f"__p.{ident}")).otherwise(F.col(f"__n.{ident}")), F.when(use_back, back).otherwise(ahead)
    return rows.withColumn("nearest", near).withColumn("distance", far).drop("__p", "__n").filter("nearest is not null")


def tiles(contigs: DataFrame, block: int = 1_000_000, slide: int = 500) -> DataFrame:
    """Overlapping tiles of each contig (chrom, length): step block - 2 slide.

    The last tile takes in what remains if that is half a block at most.
    """
    step = block - 2 * slide
    starts = F.sequence(F.lit(1).cast("long"), F.greatest(F.col("length"), F.lit(1).cast("long")), F.lit(step).cast("long"))
    rows = contigs.select("chrom", "length", F.posexplode(starts).alias("tile", "start"))
    left = F.col("length") - F.col("start") + 1
    rows = rows.filter((F.col("tile") == 0) | (left > block // 2))
    last = ~((F.col("length") - (F.col("start") + step) + 1) > block // 2)
    return rows.select("chrom", "tile", "start", F.when(last, F.col("length")).otherwise(F.least(F.col("start") + block - 1, F.col("length"))).alias("end"))


def exact_distinct(df: DataFrame, keys: list[str] = ["chrom", "start", "end"]) -> DataFrame:  # noqa: B006
    return df.dropDuplicates(keys)
