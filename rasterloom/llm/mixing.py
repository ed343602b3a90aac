"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

1. Each source's documents are shuffled (ordered by a seeded md5 of the id) and
   laid end to end as a stream of words; the stream repeats when it ends.
2. Targets: the sizes of all sources together are shared by weight; a target
   stops at ``max_repeats`` times its source and the excess is shared again.
3. The schedule is a row of slots. Slot ``n`` takes the golden-ratio point
   ``n * a mod 2**31`` and maps it through the cumulative targets to a source;
   the k-th slot of a source takes the k-th block of ``block_words`` words of its
   stream. Sources that the schedule leaves short by its discrepancy get their
   last blocks in a tail, and the last block of a source ends at its target, so
   every source yields its target to the word.

Prefix sums and ranks run in two levels (buckets of the shuffled order, chunks of
the schedule), so no window holds a whole source.

Null texts have size 0, a null source is a source of its own, null ids sort
together, repeated rows are rows of their own, an empty table gives no rows.
Documents without words are never taken. Very long texts count by their words; one
longer than a block is taken in several. Equal draws are settled by id. Columns whose
names the operator uses are set aside and given back as they were.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions.draws import draw
from rasterloom.llm.common import word_count
from rasterloom.plans.scratch import materialise

SPAN = 1 << 31
GOLDEN_STEP = 1327217885  # 2**31 divided by the golden ratio, odd, so all points of a period differ
CELLS = 4096
CHUNK = 1 << 16
ROWS_PER_BUCKET = 20_000
BLOCK_WORDS = 1024
MAX_REPEATS = 3
SEED = 11


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source, source_size, weight, target (double), words (whole words to take).

    ``sizes`` holds source and size. Sources count in code-point order, null
    last; the weights repeat along that order.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    each = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.array(*[F.lit(w) for w in weights])[F.col("place") % len(weights)].cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeats)
    )
    before = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        each.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap") * (F.col("weights") - F.col("weight_before")) <= F.col("weight") * (F.col("total") - F.col("cap_before")))
        .withColumn("cap_sum", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("cap_weight", F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(everything))
    )
    shared = (F.col("weight") * (F.col("total") - F.col("cap_sum"))).cast("double") / (F.col("weights") - F.col("cap_weight"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared)
    return filled.select("source", "place", "source_size", "weight", target.alias("target"), F.floor(target).alias("words"))


def shuffled_streams(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Each document's place in its source's shuffled stream: row, doc_id, row_hash, source, size, start."""
    columns = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    narrow = materialise(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.xxhash64(*columns).alias("row_hash"),
            "source",
            word_count("text").alias("size"),
            draw(seed, F.col("doc_id")).alias("draw"),
        ),
        "mix-sizes",
    )
    rows = narrow.count()
    digits = max(1, math.ceil(math.log(max(rows, 1) / ROWS_PER_BUCKET, 16)) + 1) if rows > ROWS_PER_BUCKET else 1
    placed = narrow.withColumn("bucket", F.substring("draw", 1, digits))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "row_hash", "row").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = local.alias("d").join(
        offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket"))
    )
    return joined.select("d.row", "d.doc_id", "d.row_hash", "d.source", "d.size", (F.col("local") + F.col("offset")).alias("start"))


def slot_schedule(spark: SparkSession, targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The slots of the mix: slot (order), source place, rank (which block of the source)."""
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bounds = (
        targets.withColumn("all_words", F.sum("words").over(everything))
        .withColumn("under", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .where("words > 0")
        .select(
            "place",
            "all_words",
            F.ceil(F.col("words") / block_words).alias("need"),
            F.floor(F.col("under") / F.col("all_words") * SPAN).alias("low"),
            F.floor((F.col("under") + F.col("words")) / F.col("all_words") * SPAN).alias("high"),
        )
    )
    head = targets.agg(F.sum("words").alias("w"), F.count("*").alias("k")).first()
    words, sources = int(head.w or 0), int(head.k or 0)
    slots = words // block_words + sources
    # The unit interval in cells: a source lies in the cells it touches, a slot in one cell.
    width = SPAN // CELLS
    cells = bounds.where("high > low").select(
        "place", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell")
    )
    points = spark.range(slots).select(
        F.col("id").alias("slot"), (((F.col("id") % SPAN) * GOLDEN_STEP) % SPAN).alias("point")
    ).withColumn("cell", F.floor(F.col("point") / width))
    drawn = points.join(cells, "cell").where("point >= low and point < high").select("slot", "place", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = drawn.groupBy("place", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("place", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("place", "chunk").orderBy("slot")
    ranked = drawn.withColumn("local", F.row_number().over(inside) - 1).join(offsets, ["place", "chunk"]).select(
        "slot", "place", (F.col("local") + F.col("offset")).alias("rank")
    )
    had = counts.groupBy("place").agg(F.sum("n").alias("had"))
    short = bounds.join(had, "place", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("need > had")
    tail = short.select("place", "had", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank")).select(
        (F.lit(slots) + (F.col("rank") - F.col("had")) * sources + F.col("place")).alias("slot"), "place", "rank"
    )
    return ranked.select("slot", "place", "rank").unionByName(tail.select("slot", "place", "rank"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """The mix as pieces of documents, and a row without a slot for each document that it leaves out.

    Columns: row, doc_id, row_hash, source, size, source_size, target, slot,
    epoch (which pass over the source), from_word and to_word (end exclusive).
    """
    streams = materialise(shuffled_streams(docs, seed), "mix-streams")
    targets = materialise(source_targets(streams, weights, max_repeats), "mix-targets")
    slots = slot_schedule(docs.sparkSession, targets, block_words)
    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    unrolled = streams.alias("d").join(targets.alias("t"), same).select("d.*", "t.place", "t.source_size", "t.target", "t.words")
    passes: Column = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: F.struct(e.alias("epoch"), (F.col("start") + e * F.col("source_size")).alias("at"))),
        lambda p: (F.col("size") > 0) & (p["at"] < F.col("words")),
    )
    spans = unrolled.select("*", F.explode_outer(passes).alias("p")).select(
        "row", "doc_id", "row_hash", "source", "size", "source_size", "target", "place",
        F.col("p.epoch").alias("epoch"), F.col("p.at").alias("at"), F.least(F.col("p.at") + F.col("size"), F.col("words")).alias("end"),
    )
    blocks = F.when(F.col("at").isNotNull(), F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("end") - 1) / block_words)))
    pieces = spans.select("*", F.explode_outer(blocks).alias("rank"))
    joined = pieces.join(slots, ["place", "rank"], "left")
    return joined.select(
        "row", "doc_id", "row_hash", "source", "size", "source_size", "target", "slot", "epoch",
        (F.greatest(F.col("at"), F.col("rank") * block_words) - F.col("at")).alias("from_word"),
        (F.least(F.col("end"), (F.col("rank") + 1) * block_words) - F.col("at")).alias("to_word"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, one row per pass over a document, with the columns of ``docs``.

    A pass that the target ends early keeps the words before the end, with the
    white space between them; ``n_chars``, where the table has it, follows.
    """
    columns = docs.columns
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    taken = (
        mix_sources(docs, **options).where("slot is not null")
        .groupBy("row", "doc_id", "row_hash", "epoch", "size")
        .agg(F.max("to_word").alias("words"))
        .select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"), F.col("words").alias("__words"), F.col("size").alias("__size"))
    )
    # Rows alike in every column are interchangeable: one copy meets all passes of the group.
    once = docs.withColumn("__row", F.xxhash64(*hashed)).dropDuplicates(["doc_id", "__row"])
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__hash"))
    early = F.col("__words") < F.col("__size")
    parts = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(parts, 1, F.col("__words").cast("int")), "")
    rows = once.join(taken, same).withColumn("text", F.when(early, cut).otherwise(F.col("text")))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(early, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in columns])
