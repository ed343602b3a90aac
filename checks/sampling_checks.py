"""Catalog queries, sampling, splits, batches and row-wise randomness."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import check
from rasterloom.operators import sampling as w
from rasterloom.plans.ranking import draw_rank

SC, CH, LC = s.SCENES, s.STREAM_CHIPS, s.LANDCOVER
PLATFORMS = ["click", "error", "purchase", "signup", "view"]


def _day(col: str):
    return F.date_format(col, "yyyy-MM-dd").alias(col)


@check(
    "s11_catalog_search",
    f"""
    SELECT item_id, tile, collection, cloud_cover, strftime(dt, '%Y-%m-%d') AS dt FROM {SC}
    WHERE collection IN ('1-URGENT', '5-LOW') AND xmin <= 60 AND xmax >= -60 AND ymin <= 40 AND ymax >= -40
      AND dt >= TIMESTAMP '1995-01-01' AND dt <= TIMESTAMP '1999-12-31' AND cloud_cover < 50
    """,
)
def _(t):
    found = w.catalog_search(
        s.scenes(t), ["1-URGENT", "5-LOW"], (-60, -40, 60, 40), "1995-01-01", "1999-12-31", 50
    )
    return found.select("item_id", "tile", "collection", "cloud_cover", _day("dt"))


@check(
    "w1_least_cloudy",
    f"""
    SELECT CAST(tile AS BIGINT) AS tile, CAST(year AS INTEGER) AS year, CAST(quarter AS INTEGER) AS quarter, item_id, cloud_cover FROM (
      SELECT *, year(dt) AS year, quarter(dt) AS quarter,
        row_number() OVER (PARTITION BY tile, year(dt), quarter(dt) ORDER BY cloud_cover, item_id) AS r FROM {SC}) WHERE r = 1
    """,
)
def _(t):
    return w.least_cloudy(s.scenes(t), keep=["item_id", "cloud_cover"])


@check(
    "w1_least_cloudy_in_ranges",
    f"""
    WITH r AS (SELECT * FROM (VALUES (DATE '1996-01-01', DATE '1996-12-31'), (DATE '1996-07-01', DATE '1998-06-30')) v(a, b))
    SELECT tile, strftime(a, '%Y-%m-%d') AS range_start, item_id, cloud_cover FROM (
      SELECT *, row_number() OVER (PARTITION BY tile, a ORDER BY cloud_cover, item_id) AS n FROM {SC} JOIN r ON dt BETWEEN a AND b)
    WHERE n = 1
    """,
)
def _(t):
    out = w.least_cloudy_in_ranges(
        s.scenes(t), [("1996-01-01", "1996-12-31"), ("1996-07-01", "1998-06-30")], ["tile"]
    )
    return out.select("tile", _day("range_start"), "item_id", "cloud_cover")


@check(
    "w2_random_years",
    """
    SELECT c_custkey, n, CAST(year AS INTEGER) AS year FROM (
      SELECT c_custkey, y AS year, row_number() OVER (PARTITION BY c_custkey ORDER BY md5('11:' || c_custkey || ':' || y)) AS r
      FROM customer, range(2018, 2024) g(y)), (VALUES (1), (2)) k(n) WHERE r <= n
    """,
)
def _(t):
    tiles = t("customer").select("c_custkey")
    one = w.random_years(tiles, 1, ["c_custkey"], 11).withColumn("n", F.lit(1))
    return one.unionByName(w.random_years(tiles, 2, ["c_custkey"], 11).withColumn("n", F.lit(2)))


_CRITERIA = [("Diversity", 40, 200), *[(str(i), 5, 50) for i in range(11)]]
_FRACTIONS = f"""
    c AS (SELECT tile, class, sum(px) AS px FROM {LC} GROUP BY tile, class),
    f AS (SELECT tile, class, px, px / sum(px) OVER (PARTITION BY tile) AS share, count(*) OVER (PARTITION BY tile) AS n_classes FROM c)
"""


def _sampled(criteria, name: str = "CAST(class AS VARCHAR)") -> str:
    return f"""
    {_FRACTIONS},
    k AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}', {n}, {h})" for i, (c, n, h) in enumerate(criteria))}) v(criterion, class, n, highest)),
    sc AS (SELECT {name} AS class, tile, share AS score FROM f
           UNION ALL SELECT 'Diversity', tile, CAST(max(n_classes) AS DOUBLE) FROM f GROUP BY tile),
    p AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY score DESC, tile) AS place FROM sc),
    q AS (SELECT criterion, p.class, tile, CAST(place AS INTEGER) AS place, n,
          row_number() OVER (PARTITION BY criterion ORDER BY md5('5:' || criterion || ':' || tile), tile) AS r
          FROM p JOIN k ON k.class = p.class AND place <= highest)
"""


_SAMPLED = _sampled(_CRITERIA)
# The published criteria name their classes; class c of the table is the c-th of them.
_NAMES = list(dict.fromkeys(c for c, _, _ in w.CRITERIA_V1 if c != w.DIVERSITY))
_NAMED = f"""[{", ".join(f"'{c}'" for c in _NAMES)}][class + 1]"""
_PUBLISHED = {"v1": w.CRITERIA_V1, "v01": w.CRITERIA_V01}


@check(
    "a7_landcover_fractions",
    f"WITH {_FRACTIONS} SELECT tile, class, CAST(px AS BIGINT) AS px, round(share, 6) AS share, n_classes FROM f",
)
def _(t):
    return w.landcover_fractions(s.landcover(t)).withColumn("share", F.round("share", 6))


@check("w4_sample_tiles", f"WITH {_SAMPLED} SELECT criterion, class, tile, place FROM q WHERE r <= n")
def _(t):
    return w.sample_tiles(w.landcover_fractions(s.landcover(t)), _CRITERIA, 5)


@check("u2_dedupe_tiles", f"WITH {_SAMPLED} SELECT DISTINCT tile FROM q WHERE r <= n")
def _(t):
    return w.dedupe_tiles(w.sample_tiles(w.landcover_fractions(s.landcover(t)), _CRITERIA, 5))


def _published(t, release: str):
    shares = w.landcover_fractions(s.landcover(t))
    named = shares.withColumn("class", F.element_at(F.array(*[F.lit(c) for c in _NAMES]), (F.col("class") + 1).cast("int")))
    return w.sample_tiles(named, _PUBLISHED[release], 5)


for _release, _table in _PUBLISHED.items():
    _sql = f"WITH {_sampled(_table, _NAMED)}"
    check(f"w4_sample_tiles_{_release}", f"{_sql} SELECT criterion, class, tile, place FROM q WHERE r <= n")(
        lambda t, release=_release: _published(t, release)
    )
    check(f"u2_dedupe_tiles_{_release}", f"{_sql} SELECT DISTINCT tile FROM q WHERE r <= n")(
        lambda t, release=_release: w.dedupe_tiles(_published(t, release))
    )


@check(
    "w5_bounded_fraction",
    f"""
    SELECT collection, item_id FROM (SELECT *, count(*) OVER (PARTITION BY collection) AS n,
      row_number() OVER (PARTITION BY collection ORDER BY md5('3:' || item_id), item_id) AS r FROM {SC})
    WHERE r <= least(2000, greatest(10, CAST(floor(n * 0.5) AS BIGINT)))
    """,
)
def _(t):
    return w.bounded_fraction(s.scenes(t).select("collection", "item_id"), ["collection"], ["item_id"], 3)


@check(
    "w6_first_per_month",
    f"SELECT tile, strftime(dt, '%Y-%m') AS month, min(item_id) AS item_id FROM {SC} GROUP BY ALL",
)
def _(t):
    return w.first_per_month(s.scenes(t), ["tile"], "item_id", ["item_id"])


@check(
    "w7_one_per_date",
    f"SELECT strftime(dt, '%Y-%m-%d') AS date, min(item_id) AS item_id, arg_min(cloud_cover, item_id) AS cloud_cover FROM {SC} GROUP BY 1",
)
def _(t):
    return w.one_per_date(s.scenes(t), "item_id", ["item_id", "cloud_cover"])


@check(
    "w8_head_per_group",
    """
    SELECT dir, name FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY name) AS r FROM (
      SELECT p_brand AS dir, 'cube_' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.npz' AS name FROM part)) WHERE r <= 100
    """,
)
def _(t):
    name = F.concat(F.lit("cube_"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit(".npz"))
    return w.head_per_group(t("part").select(F.col("p_brand").alias("dir"), name.alias("name")), "dir", "name", 100)


@check(
    "w9_sample_ids",
    """
    SELECT o_orderkey FROM (SELECT o_orderkey, count(*) OVER () AS n,
      row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= floor(n * 0.05)
    """,
)
def _(t):
    return w.sample_ids(t("orders").select("o_orderkey"), 0.05, 42, ["o_orderkey"])


@check(
    "w10_stratified_split",
    f"""
    SELECT chip_id, platform, CASE WHEN r <= round(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM (
      SELECT *, count(*) OVER (PARTITION BY platform) AS n,
        row_number() OVER (PARTITION BY platform ORDER BY md5('1:' || chip_id), chip_id) AS r FROM {CH})
    """,
)
def _(t):
    return w.stratified_split(s.stream_chips(t), ["platform"], ["chip_id"], 1)


@check(
    "w11_random_split",
    """
    SELECT o_orderkey, CASE WHEN r <= ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM (
      SELECT o_orderkey, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r FROM orders)
    """,
)
def _(t):
    return w.random_split(t("orders").select("o_orderkey"), ["o_orderkey"])


@check(
    "w11_index_split",
    "SELECT vec_id, CASE WHEN label IN (2, 5, 6) THEN 'test' ELSE 'train' END AS split FROM embeddings",
)
def _(t):
    return w.index_split(s.embeddings(t), "label", [2, 5, 6]).select("vec_id", "split")


_RANKED = f"""
    n AS (SELECT platform, count(*) AS n FROM {CH} GROUP BY platform),
    m AS (SELECT max(n) AS m FROM n),
    r AS (SELECT c.*, n.n, row_number() OVER (PARTITION BY c.platform ORDER BY md5('7:' || chip_id), chip_id) - 1 AS r
          FROM {CH} c JOIN n USING (platform))
"""
_POS = "CASE platform " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PLATFORMS)) + " END"


@check(
    "w12_balanced_batches",
    f"""
    WITH {_RANKED}, o AS (SELECT chip_id, platform, unnest(range(r, (m // 64) * 64, n)) AS i FROM r, m)
    SELECT chip_id, platform, i // 64 AS batch_no, i % 64 AS slot, (i // 64) * 5 + {_POS} AS batch_order FROM o
    """,
)
def _(t):
    return w.balanced_batches(s.stream_chips(t), PLATFORMS, 64, ["chip_id"], 7)


@check(
    "w13_distributed_batches",
    f"""
    WITH {_RANKED}, o AS (SELECT chip_id, platform, n, r, m, unnest(range(r, m, n)) AS i FROM r, m),
    p AS (SELECT *, (i - r) // n AS rep FROM o),
    q AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY md5('7:2:' || chip_id || ':' || rep), chip_id, rep) - 1 AS k, m // 4 AS per FROM p),
    l AS (SELECT *, k // per AS replica, k % per AS local FROM q WHERE k < per * 4)
    SELECT chip_id, platform, rep, replica, local // 16 AS batch_no, local % 16 AS slot, (local // 16) * 5 + {_POS} AS batch_order
    FROM l WHERE local // 16 < per // 16
    """,
)
def _(t):
    return w.distributed_batches(s.stream_chips(t), PLATFORMS, 16, ["chip_id"], 4, 7, epoch=2)


@check(
    "l2_limit_fraction",
    f"""
    WITH {_RANKED}, o AS (SELECT chip_id, platform, unnest(range(r, (m // 64) * 64, n)) AS i FROM r, m),
    b AS (SELECT chip_id, (i // 64) * 5 + {_POS} AS batch_order FROM o)
    SELECT chip_id, batch_order FROM b WHERE batch_order < (SELECT floor((max(batch_order) + 1) * 0.25) FROM b)
    """,
)
def _(t):
    batches = w.balanced_batches(s.stream_chips(t), PLATFORMS, 64, ["chip_id"], 7)
    return w.limit_fraction(batches, 0.25).select("chip_id", "batch_order")


@check(
    "w14_random_chips_per_item",
    """
    SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey,
      row_number() OVER (PARTITION BY o_custkey ORDER BY md5('9:' || o_custkey || ':' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 5
    """,
)
def _(t):
    return w.random_chips_per_item(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 5, 9)


_SEGMENTS = "CASE c_mktsegment WHEN 'BUILDING' THEN 'place' WHEN 'AUTOMOBILE' THEN 'park' WHEN 'MACHINERY' THEN 'airport' ELSE 'port' END"


@check(
    "w15_sample_places",
    f"""
    WITH o AS (SELECT 'river' AS kind, o_custkey AS feature_id, o_orderkey AS point_no, (o_orderkey * 37 % 2500) / 100.0::DOUBLE AS lon, (o_orderkey * 91 % 2000) / 100.0::DOUBLE AS lat FROM orders
      UNION ALL SELECT 'lake', event_id % 700, event_id, (event_id * 37 % 2500) / 100.0::DOUBLE, (event_id * 91 % 2000) / 100.0::DOUBLE FROM events),
    one AS (SELECT *, row_number() OVER (PARTITION BY kind, feature_id ORDER BY md5('13:' || kind || ':' || feature_id || ':' || point_no), point_no) AS r FROM o),
    c AS (SELECT p_partkey AS place_id, (p_partkey * 37 % 2500) / 100.0::DOUBLE AS lon, (p_partkey * 91 % 2000) / 100.0::DOUBLE AS lat,
      row_number() OVER (ORDER BY md5('13:' || p_partkey), p_partkey) AS r FROM part),
    u AS (SELECT {_SEGMENTS} AS kind, c_custkey AS place_id, (c_custkey * 37 % 2500) / 100.0::DOUBLE AS lon, (c_custkey * 91 % 2000) / 100.0::DOUBLE AS lat FROM customer
      UNION ALL SELECT kind, feature_id, lon, lat FROM one WHERE r = 1
      UNION ALL SELECT 'random', place_id, lon, lat FROM c WHERE r <= 4000)
    SELECT kind, place_id, lon, lat FROM u WHERE lon BETWEEN 4 AND 21 AND lat BETWEEN 3 AND 17
    """,
)
def _(t):
    def at(key: str) -> list:
        return [((F.col(key) * 37 % 2500) / 100.0).alias("lon"), ((F.col(key) * 91 % 2000) / 100.0).alias("lat")]

    kind = (
        F.when(F.col("c_mktsegment") == "BUILDING", "place")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "park")
        .when(F.col("c_mktsegment") == "MACHINERY", "airport")
        .otherwise("port")
    )
    places = t("customer").select(kind.alias("kind"), F.col("c_custkey").alias("place_id"), *at("c_custkey"))
    rivers = t("orders").select(
        F.lit("river").alias("kind"), F.col("o_custkey").alias("feature_id"), F.col("o_orderkey").alias("point_no"), *at("o_orderkey")
    )
    lakes = t("events").select(
        F.lit("lake").alias("kind"), (F.col("event_id") % 700).alias("feature_id"), F.col("event_id").alias("point_no"), *at("event_id")
    )
    candidates = t("part").select(F.col("p_partkey").alias("place_id"), *at("p_partkey"))
    return w.sample_places(places, rivers.unionByName(lakes), candidates, (4, 3, 21, 17), 13)


@check(
    "l1_limit_rows",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000",
)
def _(t):
    return w.limit_rows(t("orders").select("o_orderkey", "o_totalprice"), 1000, F.desc("o_totalprice"), "o_orderkey")


@check(
    "l3_shuffle",
    "SELECT o_orderkey, row_number() OVER (ORDER BY md5('21:' || o_orderkey), o_orderkey) AS position FROM orders",
)
def _(t):
    # the order itself is not visible in a set of rows, so its position is returned
    return draw_rank(t("orders").select("o_orderkey"), [], ["o_orderkey"], 21, "position")


@check(
    "w16_mask_patches",
    """
    SELECT vec_id, CAST(p AS INTEGER) AS patch_idx, CAST(o AS INTEGER) AS mask_order, CAST(o < floor(64 * 0.7) AS INTEGER) AS masked FROM (
      SELECT vec_id, p, row_number() OVER (PARTITION BY vec_id ORDER BY md5('17:' || vec_id || ':' || p), p) - 1 AS o
      FROM embeddings, range(64) r(p))
    """,
)
def _(t):
    return w.mask_patches(t("embeddings"), F.size("embedding"), 0.7, 17, ["vec_id"])


_U = "(('0x' || substr(md5('{seed}:' || chip_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@check(
    "w17_augment",
    f"""
    SELECT chip_id, band_idx, CAST((CASE WHEN {_U.format(seed="19:vertical")} < 0.5 THEN 3 - px // 4 ELSE px // 4 END) * 4
      + (CASE WHEN {_U.format(seed="19:horizontal")} < 0.5 THEN 3 - px % 4 ELSE px % 4 END) AS BIGINT) AS px, round(v, 6) AS v
    FROM {s.CHIP_PIXELS}
    """,
)
def _(t):
    return s.pixel_rows(w.augment(s.chips(t), 19, ["chip_id"]), ["chip_id"])


def _located(t):
    """Chips with time and location; every ninth has none."""
    lat = F.when(F.col("chip_id") % 9 == 0, F.lit(0.0)).otherwise(F.lit(0.5))
    return s.chips(t).withColumn("latlon", F.array(lat, lat, lat, lat)).withColumn("time", F.array(*[F.lit(0.25)] * 4))


@check(
    "w18_drop_metadata",
    f"""
    SELECT chip_id, CASE WHEN {_U.format(seed=23)} < 0.2 THEN 0.0::DOUBLE ELSE 1.0 END AS time_sum,
      CASE WHEN {_U.format(seed=23)} < 0.2 OR chip_id % 9 = 0 THEN 0.0::DOUBLE ELSE 2.0 END AS latlon_sum FROM {s.CHIPS}
    """,
)
def _(t):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    out = w.drop_metadata(_located(t), 23, ["chip_id"])
    return out.select("chip_id", total("time").alias("time_sum"), total("latlon").alias("latlon_sum"))


@check(
    "w19_drop_channels",
    f"""
    WITH c AS (SELECT *, {_U.format(seed=29)} AS u FROM {s.CHIPS}),
    r AS (SELECT chip_id, u, n_bands, b, row_number() OVER (PARTITION BY chip_id ORDER BY md5('29:channel:' || chip_id || ':' || b), b) AS r
          FROM c, range(4) g(b) WHERE b < n_bands)
    SELECT p.chip_id, p.band_idx, p.px, round(CASE WHEN p.chip_id % 9 <> 0 AND (u < 0.1 OR (u < 0.1::DOUBLE + 0.2::DOUBLE AND r <= n_bands // 2)) THEN 0 ELSE v END, 6) + 0 AS v
    FROM {s.CHIP_PIXELS} p JOIN r ON r.chip_id = p.chip_id AND r.b = p.band_idx
    """,
)
def _(t):
    long = s.pixel_rows(w.drop_channels(_located(t), 29, ["chip_id"]), ["chip_id"])
    return long.withColumn("v", F.col("v") + 0.0)  # -0.0 to 0.0
