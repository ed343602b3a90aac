"""Seeded sampling, splits and batches.

Nothing here depends on partitioning or on a random generator: order comes from
md5 draws of the row keys (see ``functions.draws``), ranks from
``plans.ranking``, so results are exact and repeatable after task retries.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.binding import let
from rasterloom.functions.draws import draw, uniform
from rasterloom.functions.geo import box, boxes_overlap
from rasterloom.plans.ranking import best_row, draw_cut, draw_rank, draw_within, top_per_group

# Fixed values: (class, tiles drawn, from how many highest), current and previous release.
CRITERIA_V1 = [
    ("Diversity", 400, 2000),
    ("Built-up", 300, 300),
    ("Built-up", 1000, 1500),
    ("Herbaceous wetland", 50, 500),
    ("Mangroves", 50, 500),
    ("Moss and lichen", 50, 500),
    ("Cropland", 800, 3600),
    ("Tree cover", 150, 750),
    ("Shrubland", 100, 500),
    ("Grassland", 200, 500),
    ("Bare / sparse vegetation", 50, 500),
    ("Snow and Ice", 25, 500),
    ("Permanent water bodies", 50, 1000),
]
CRITERIA_V01 = [
    ("Diversity", 500, 3000),
    ("Built-up", 400, 400),
    ("Herbaceous wetland", 50, 500),
    ("Mangroves", 50, 500),
    ("Moss and lichen", 50, 500),
    ("Cropland", 100, 500),
    ("Tree cover", 100, 500),
    ("Shrubland", 50, 500),
    ("Grassland", 50, 500),
    ("Bare / sparse vegetation", 50, 500),
    ("Snow and Ice", 50, 500),
    ("Permanent water bodies", 100, 1000),
]
DIVERSITY = "Diversity"
YEARS = range(2018, 2024)


# -- catalog ---------------------------------------------------------------


def catalog_search(
    scenes: DataFrame,
    collections: list[str] | None = None,
    bbox: tuple[float, float, float, float] | None = None,
    start: dt.date | dt.datetime | str | None = None,
    end: dt.date | dt.datetime | str | None = None,
    cloud_lt: float | None = None,
    max_items: int | None = None,
    order: tuple[str, ...] = ("item_id",),
) -> DataFrame:
    """Plain comparisons, so every one of them reaches the Parquet scan."""
    out = scenes
    if collections:
        out = out.filter(F.col("collection").isin(*collections))
    if bbox:
        out = out.filter(boxes_overlap(F.col("bbox"), box(*[F.lit(float(v)) for v in bbox])))
    kind = scenes.schema["dt"].dataType
    if start is not None:
        out = out.filter(F.col("dt") >= F.lit(str(start)).cast(kind))
    if end is not None:
        out = out.filter(F.col("dt") <= F.lit(str(end)).cast(kind))
    if cloud_lt is not None:
        out = out.filter(F.col("cloud_cover") < cloud_lt)
    if max_items is not None:
        out = limit_rows(out, max_items, *order)
    return out


def least_cloudy(scenes: DataFrame, by: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The clearest scene per tile, year and quarter (or per given columns), ties by item id."""
    if by is None:
        scenes = scenes.withColumn("year", F.year("dt")).withColumn("quarter", F.quarter("dt"))
        by = ["tile", "year", "quarter"]
    return best_row(scenes, by, ["cloud_cover", "item_id"], keep or ["item_id", "cloud_cover", "dt"])


def least_cloudy_in_ranges(scenes: DataFrame, ranges: list[tuple[str, str]], by: list[str]) -> DataFrame:
    """The clearest scene per group and (inclusive) date range."""
    kind = scenes.schema["dt"].dataType
    table = F.array(
        *[F.struct(F.lit(a).cast(kind).alias("start"), F.lit(b).cast(kind).alias("end")) for a, b in ranges]
    )
    spread = scenes.withColumn("_range", F.explode(F.filter(table, lambda r: F.col("dt").between(r["start"], r["end"]))))
    spread = spread.withColumn("range_start", F.col("_range.start"))
    return best_row(spread, [*by, "range_start"], ["cloud_cover", "item_id"], ["item_id", "cloud_cover", "dt"])


def random_years(tiles: DataFrame, n: int, key: list[str], seed: int, years: range = YEARS) -> DataFrame:
    """``n`` random years per tile; all inside the row, no join and no window."""
    drawn = F.array(*[F.struct(draw(seed, *key, y).alias("d"), F.lit(y).alias("year")) for y in years])
    return tiles.withColumn("year", F.explode(F.slice(F.array_sort(drawn), 1, n)["year"]))


def first_k_years(matches: DataFrame, tile: str, year: str, k: int, seed: int) -> DataFrame:
    """Random year order per tile; keep the first ``k`` years that have a match."""
    years = matches.groupBy(tile, year).agg(F.count(F.lit(1)).alias("n_matches"))
    order = Window.partitionBy(tile).orderBy(draw(seed, tile, year), year)  # as many rows as years
    return years.withColumn("year_rank", F.row_number().over(order)).filter(F.col("year_rank") <= k)


def first_per_month(scenes: DataFrame, by: list[str], rank: str, keep: list[str]) -> DataFrame:
    """The first search result per group and calendar month."""
    return best_row(scenes.withColumn("month", F.date_format("dt", "yyyy-MM")), [*by, "month"], [rank], keep)


def one_per_date(items: DataFrame, rank: str, keep: list[str]) -> DataFrame:
    """The first search result per calendar date."""
    return best_row(items.withColumn("date", F.date_format("dt", "yyyy-MM-dd")), ["date"], [rank], keep)


def bounded_fraction(
    scenes: DataFrame, by: list[str], key: list[str], seed: int, fraction: float = 0.5, least: int = 10, most: int = 2000
) -> DataFrame:
    """A random fraction of each catalog, at least ``least`` and at most ``most`` rows."""
    share = F.floor(F.col("group_size") * F.lit(fraction))
    return draw_cut(scenes, by, key, seed, F.least(F.lit(most), F.greatest(F.lit(least), share)))


# -- land cover ------------------------------------------------------------


def landcover_fractions(pixels: DataFrame) -> DataFrame:
    """(tile, class, px) rows to class share and class count per tile."""
    per_class = pixels.groupBy("tile", "class").agg(F.sum("px").alias("px"))
    tile = Window.partitionBy("tile")  # at most one row per class
    return per_class.withColumn("share", F.col("px") / F.sum("px").over(tile)).withColumn(
        "n_classes", F.count(F.lit(1)).over(tile)
    )


def sample_tiles(fractions: DataFrame, criteria: list[tuple[str, int, int]], seed: int) -> DataFrame:
    """Per criterion, ``n`` random tiles of the ``highest`` by class share (or by class count)."""
    spark = fractions.sparkSession
    rows = [(i, str(c), n, highest) for i, (c, n, highest) in enumerate(criteria)]
    wanted = F.broadcast(spark.createDataFrame(rows, "criterion int, class string, n int, highest int"))
    shares = fractions.select(F.col("class").cast("string").alias("class"), "tile", F.col("share").alias("score"))
    # one row per tile, taken from its classes: no second pass over the pixels
    counts = fractions.groupBy("tile").agg(F.max("n_classes").cast("double").alias("score")).select(
        F.lit(DIVERSITY).alias("class"), "tile", "score"
    )
    scored = shares.join(wanted.select("class").distinct(), "class", "left_semi").unionByName(counts)
    highest = max(h for _, _, h in criteria)
    top = top_per_group(scored, ["class"], [F.desc("score"), F.asc("tile")], highest, ["tile"], rank="place")
    pool = top.join(wanted, "class").filter(F.col("place") <= F.col("highest"))
    # at most ``highest`` rows per criterion are left, whatever the input size
    order = Window.partitionBy("criterion").orderBy(draw(seed, "criterion", "tile"), "tile")
    return (
        pool.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= F.col("n"))
        .select("criterion", "class", "tile", "place")
    )


def dedupe_tiles(sampled: DataFrame) -> DataFrame:
    return sampled.select("tile").distinct()


def sample_places(
    places: DataFrame, outlines: DataFrame, candidates: DataFrame, region: tuple[float, float, float, float], seed: int, n_random: int = 4000
) -> DataFrame:
    """All places, one random point per outline feature, ``n_random`` random points; region only.

    ``places(kind, place_id, lon, lat)``, ``outlines(kind, feature_id, point_no, lon, lat)``
    and ``candidates(place_id, lon, lat)``.
    """
    xmin, ymin, xmax, ymax = region
    inside = F.col("lon").between(xmin, xmax) & F.col("lat").between(ymin, ymax)
    drawn = outlines.withColumn("_draw", draw(seed, "kind", "feature_id", "point_no"))
    single = best_row(drawn, ["kind", "feature_id"], ["_draw", "point_no"], ["lon", "lat"]).withColumnRenamed(
        "feature_id", "place_id"
    )
    extra = candidates.orderBy(draw(seed, "place_id"), "place_id").limit(n_random).withColumn("kind", F.lit("random"))
    cols = ["kind", "place_id", "lon", "lat"]
    return places.select(*cols).unionByName(single.select(*cols)).unionByName(extra.select(*cols)).filter(inside)


# -- heads, splits and order -----------------------------------------------


def head_per_group(files: DataFrame, by: str | list[str], order: str, k: int = 100) -> DataFrame:
    """The first ``k`` per group."""
    by = [by] if isinstance(by, str) else by
    return top_per_group(files, by, [F.col(order)], k, [order], "_r").drop("_r")


def sample_ids(ids: DataFrame, fraction: float, seed: int, key: list[str]) -> DataFrame:
    """Exactly ``int(n * fraction)`` rows; everything when the fraction is 1 or more."""
    if fraction >= 1:
        return ids
    return draw_cut(ids, [], key, seed, F.floor(F.col("group_size") * F.lit(fraction)))


def stratified_split(chips: DataFrame, by: list[str], key: list[str], seed: int, train: float = 0.8) -> DataFrame:
    """``split`` is train for exactly ``round(n * train)`` rows of every stratum."""
    marked = draw_within(chips, by, key, seed, F.round(F.col("group_size") * F.lit(train)), "_first")
    return marked.withColumn("split", F.when(F.col("_first"), "train").otherwise("val")).drop("_first")


def random_split(df: DataFrame, key: list[str], seed: int = 42, test: float = 0.3) -> DataFrame:
    """``split`` is test for exactly ``ceil(n * test)`` rows."""
    marked = draw_within(df, [], key, seed, F.ceil(F.col("group_size") * F.lit(test)), "_first")
    return marked.withColumn("split", F.when(F.col("_first"), "test").otherwise("train")).drop("_first")


def index_split(df: DataFrame, key: str, test: list) -> DataFrame:
    """``split`` from an explicit list of test keys."""
    return df.withColumn("split", F.when(F.col(key).isin(*test), "test").otherwise("train"))


def random_chips_per_item(chips: DataFrame, item: str, key: list[str], k: int, seed: int | None) -> DataFrame:
    """``k`` random chips per item; the first ``k`` when no seed is given."""
    order = [draw(seed, item, *key)] if seed is not None else []
    return top_per_group(chips, [item], [*order, *[F.col(c) for c in key]], k, key, "_r").drop("_r")


def shuffle(df: DataFrame, seed: int, key: list[str]) -> DataFrame:
    """Draw order as a global (range-partitioned) sort."""
    return df.orderBy(draw(seed, *key), *key)


def limit_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def limit_fraction(batches: DataFrame, fraction: float, order: str = "batch_order") -> DataFrame:
    """The first ``floor(n * fraction)`` of ``n`` batches numbered from 0."""
    total = batches.agg(F.coalesce(F.max(order) + 1, F.lit(0)).alias("n")).scalar()
    return batches.filter(F.col(order) < F.floor(total * F.lit(fraction)))


# -- balanced batches --------------------------------------------------------

CHUNK = 1 << 16  # repeats made from one row at a time


def _longest(chips: DataFrame) -> Column:
    sizes = chips.groupBy("platform").agg(F.count(F.lit(1)).alias("n"))
    return F.coalesce(sizes.agg(F.max("n").alias("n")).scalar(), F.lit(0))


def _repeated(ranked: DataFrame, limit: Column, key: list[str]) -> DataFrame:
    """Positions r, r+n, r+2n, ... below ``limit`` for the row of rank r in a platform of n.

    A tiny platform repeats its few rows very often, so repeats are made in
    chunks and the chunks are spread before the last step.
    """
    start, step = F.col("_rank") - 1, F.col("_n")
    times = F.ceil((F.col("_limit") - start) / step)
    chunks = (
        ranked.withColumn("_limit", limit)
        .filter(start < F.col("_limit"))
        .withColumn("_times", times)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_times") - 1) / CHUNK))))
        .repartition(F.col("platform"), *[F.col(k) for k in key], F.col("_chunk"))
    )
    low = F.col("_chunk") * CHUNK
    high = F.least(low + CHUNK, F.col("_times")) - 1
    return chunks.withColumn("_rep", F.explode(F.sequence(low, high))).withColumn(
        "_i", start + F.col("_rep") * step
    )


def _platform_pos(platforms: list[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(p) for p in platforms]), F.col("platform")) - 1).cast("bigint")


def balanced_batches(chips: DataFrame, platforms: list[str], size: int, key: list[str], seed: int) -> DataFrame:
    """Full single-platform batches in turn; short platforms repeat up to the longest one.

    Adds ``batch_no`` (within the platform), ``slot`` and ``batch_order`` (global).
    """
    chips = chips.filter(F.col("platform").isin(*platforms))
    ranked = draw_rank(chips, ["platform"], key, seed, "_rank", "_n")
    full = F.floor(_longest(chips) / size) * size
    placed = _repeated(ranked, full, key)
    return placed.select(
        *chips.columns,
        F.floor(F.col("_i") / size).alias("batch_no"),
        (F.col("_i") % size).alias("slot"),
        (F.floor(F.col("_i") / size) * len(platforms) + _platform_pos(platforms)).alias("batch_order"),
    )


def distributed_batches(
    chips: DataFrame,
    platforms: list[str],
    size: int,
    key: list[str],
    replicas: int,
    seed: int,
    epoch: int = 0,
    rank: int | None = None,
) -> DataFrame:
    """Balanced batches cut into equal contiguous slices per replica.

    Platforms are first repeated to the longest length, then shuffled by
    (seed, epoch); slice ``r`` is positions ``[r*per, (r+1)*per)``.
    """
    chips = chips.filter(F.col("platform").isin(*platforms))
    longest = _longest(chips)
    ranked = draw_rank(chips, ["platform"], key, seed, "_rank", "_n")
    tiled = _repeated(ranked, longest, key).select(*chips.columns, "_rep", longest.alias("_longest"))
    mixed = draw_rank(tiled, ["platform"], [*key, "_rep"], f"{seed}:{epoch}", "_place")
    per = F.floor(F.col("_longest") / replicas)
    place = F.col("_place") - 1
    out = (
        mixed.withColumn("_per", per)
        .filter(place < F.col("_per") * replicas)
        .withColumn("replica", F.floor(place / F.col("_per")))
        .withColumn("_local", place - F.col("replica") * F.col("_per"))
        .withColumn("batch_no", F.floor(F.col("_local") / size))
        .filter(F.col("batch_no") < F.floor(F.col("_per") / size))
    )
    if rank is not None:
        out = out.filter(F.col("replica") == rank)
    return out.select(
        *chips.columns,
        F.col("_rep").alias("rep"),
        "replica",
        "batch_no",
        (F.col("_local") % size).alias("slot"),
        (F.col("batch_no") * len(platforms) + _platform_pos(platforms)).alias("batch_order"),
    )


# -- row-wise randomness -----------------------------------------------------


def mask_patches(chips: DataFrame, patches: Column, ratio: float, seed: int | None, key: list[str]) -> DataFrame:
    """One row per patch: ``masked`` marks the first ``int(ratio * L)`` in random (or natural) order.

    ``mask_order`` is the position in that order. Sorting happens inside the row.
    """
    natural = F.sequence(F.lit(0), patches - 1)
    if seed is None:
        shuffled = natural
    else:
        shuffled = F.array_sort(
            F.transform(natural, lambda i: F.struct(draw(seed, *key, i).alias("d"), i.alias("i")))
        )["i"]
    return chips.select(
        *key, F.posexplode(shuffled).alias("mask_order", "patch_idx"), patches.alias("_l")
    ).select(*key, "patch_idx", "mask_order", (F.col("mask_order") < F.floor(F.col("_l") * F.lit(ratio))).cast("int").alias("masked"))


def augment(chips: DataFrame, seed: int, key: list[str], p: float = 0.5) -> DataFrame:
    """Horizontal and vertical flips, each with probability ``p``."""
    from rasterloom.functions.pixels import flip_horizontal, flip_vertical

    h, w = F.col("h"), F.col("w")
    flip = lambda name, fn, pix: F.when(
        uniform(f"{seed}:{name}", *key) < p, F.transform(pix, lambda b: fn(b, h, w))
    ).otherwise(pix)
    once = chips.withColumn("pixels", flip("horizontal", flip_horizontal, F.col("pixels")))
    return once.withColumn("pixels", flip("vertical", flip_vertical, F.col("pixels")))


def drop_metadata(chips: DataFrame, seed: int, key: list[str], p: float = 0.2) -> DataFrame:
    """Zero time and location together."""
    gone = uniform(seed, *key) < p
    zero = lambda c: F.when(gone, F.transform(c, lambda _: F.lit(0.0))).otherwise(F.col(c))
    return chips.withColumn("time", zero("time")).withColumn("latlon", zero("latlon"))


def drop_channels(chips: DataFrame, seed: int, key: list[str], p_all: float = 0.1, p_half: float = 0.2) -> DataFrame:
    """Zero all channels, or a random half of them; chips without location are left alone."""
    located = F.exists("latlon", lambda v: v != 0)
    u = uniform(seed, *key)
    n = F.size("pixels")
    order = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), n - 1), lambda c: F.struct(draw(f"{seed}:channel", *key, c).alias("d"), c.alias("c"))
        )
    )["c"]
    half = F.slice(order, F.lit(1), F.floor(n / 2).cast("int"))
    gone = (
        F.when(~located, F.array().cast("array<int>"))
        .when(u < p_all, F.sequence(F.lit(0), n - 1))
        .when(u < p_all + p_half, half)
        .otherwise(F.array().cast("array<int>"))
    )
    def zeroed(out: Column) -> Column:
        dark = lambda band: F.transform(band, lambda v: v * 0)
        return F.transform(
            "pixels", lambda band, c: F.when(F.array_contains(out, c), dark(band)).otherwise(band)
        )

    return chips.withColumn("pixels", let(gone, zeroed))
