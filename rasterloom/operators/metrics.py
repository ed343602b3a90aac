"""Distributed evaluation: classification, regression, reconstruction and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.binding import let
from rasterloom.functions.vectors import cosine

# Fixed values of the losses.
SLOW_SENSOR = "modis"
SLOW_SENSOR_SCALE = 10
REC_WEIGHT = 0.9
REP_WEIGHT = 0.1
VARIANCE_FLOOR = 1e-6
PREFIX_EPS = 1e-6
BIOMASS_LIMIT = 400


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Counts per (label, prediction); rows without a label are left out."""
    return (
        df.filter(F.col(label).isNotNull())
        .groupBy(*(by or []), F.col(label).alias("label"), F.col(pred).alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_metrics(df: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Per class: support, precision, recall, F1, Jaccard and Dice, from the confusion counts alone."""
    by = by or []
    cells = confusion(df, label, pred, by)
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("pred").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )
    folded = (
        cells.select(*by, F.explode(sides).alias("s"))
        .filter(F.col("s.cls").isNotNull())
        .groupBy(*by, F.col("s.cls").alias("cls"))
        .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.tp").alias("tp"))
    )
    tp, sup, prd = F.col("tp"), F.col("support"), F.col("predicted")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return folded.select(
        *by,
        "cls",
        "support",
        "predicted",
        "tp",
        ratio(tp, prd).alias("precision"),
        ratio(tp, sup).alias("recall"),
        ratio(2 * tp, sup + prd).alias("f1"),
        ratio(tp, sup + prd - tp).alias("jaccard"),
        ratio(2 * tp, sup + prd).alias("dice"),
    )


def classification_metrics(
    df: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | None = None, positive: int | None = None
) -> DataFrame:
    """Accuracy, support-weighted F1 and Jaccard, macro Dice, precision and recall.

    Precision and recall are those of the ``positive`` class if one is named,
    macro averages otherwise.
    """
    by = by or []
    per_class = class_metrics(df, label, pred, by)
    weighted = lambda c: F.sum(F.col("support") * F.col(c)) / F.sum("support")

    def focus(c: str) -> Column:
        return F.avg(c) if positive is None else F.max(F.when(F.col("cls") == positive, F.col(c)))

    return per_class.groupBy(*by).agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        focus("precision").alias("precision"),
        focus("recall").alias("recall"),
        weighted("f1").alias("f1_weighted"),
        weighted("jaccard").alias("jaccard_weighted"),
        F.avg("dice").alias("dice"),
    )


def regression_metrics(
    df: DataFrame, sample: str, target: str = "target", pred: str = "pred", limit: float = BIOMASS_LIMIT
) -> DataFrame:
    """RMSE over everything, and the mean over samples of the RMSE below ``limit``.

    A sample without a valid target does not enter the second mean.
    """
    err = F.pow(F.col(pred) - F.col(target), 2)
    per_sample = df.groupBy(sample).agg(
        F.sum(err).alias("_sse"), F.count(err).alias("_n"), F.avg(F.when(F.col(target) < limit, err)).alias("_mse")
    )
    return per_sample.agg(
        F.sqrt(F.sum("_sse") / F.sum("_n")).alias("rmse"),
        F.avg(F.sqrt("_mse")).alias("valid_rmse"),
        F.count("_mse").alias("valid_samples"),
    )


def _standardised(vals: Column) -> Column:
    n = F.size(vals)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)

    def scaled(mean: Column) -> Column:
        spread = total(F.transform(vals, lambda v: (v - mean) * (v - mean))) / (n - 1)
        return let(
            F.sqrt(spread + F.lit(VARIANCE_FLOOR)), lambda dev: F.transform(vals, lambda v: (v - mean) / dev)
        )

    return let(total(vals) / n, scaled)


def masked_l1(patches: DataFrame, by: list[str] | None = None, standardise: bool = False) -> DataFrame:
    """L1 per patch, averaged over masked patches (vals, recon, masked); NULL where nothing is masked."""
    truth = F.col("vals")
    if standardise:
        patches = patches.withColumn("vals", _standardised(truth))
    gaps = F.zip_with("vals", "recon", lambda a, b: F.abs(a - b))
    loss = F.aggregate(gaps, F.lit(0.0), lambda a, v: a + v) / F.size(gaps)
    mask = F.col("masked")
    return patches.groupBy(*(by or [])).agg(F.try_divide(F.sum(loss * mask), F.sum(mask)).alias("loss"))


def combined_loss(
    df: DataFrame,
    by: list[str],
    rec: str = "rec_loss",
    similarity: str = "similarity",
    rec_weight: float = REC_WEIGHT,
    rep_weight: float = REP_WEIGHT,
) -> DataFrame:
    """Reconstruction (scaled down for the slow sensor) plus one minus mean similarity."""
    scaled = F.when(F.col("platform") == SLOW_SENSOR, F.col(rec) / SLOW_SENSOR_SCALE).otherwise(F.col(rec))
    parts = df.groupBy(*by).agg(F.avg(scaled).alias("rec_loss"), (1.0 - F.avg(similarity)).alias("rep_loss"))
    return parts.withColumn("loss", rec_weight * F.col("rec_loss") + rep_weight * F.col("rep_loss"))


def matryoshka_loss(df: DataFrame, weights: dict[int, float], rep: str = "rep", target: str = "target") -> DataFrame:
    """Weighted mean over prefixes of the mean cosine distance; rows are (prefix, rep, target)."""
    pairs = [F.lit(x) for p, w in weights.items() for x in (p, float(w))]
    weight = F.try_element_at(F.create_map(*pairs), F.col("prefix"))
    per_prefix = df.groupBy("prefix").agg(F.avg(1.0 - cosine(rep, target, PREFIX_EPS)).alias("distance"))
    return per_prefix.agg((F.sum(weight * F.col("distance")) / F.count(F.lit(1))).alias("loss"))


def metric_rollup(log: DataFrame) -> DataFrame:
    """Averages per (phase, name) and per (phase, platform, name), each per step and per epoch.

    ``series`` is ``phase/name`` or ``phase_platform/name``; ``grain`` says which clock.
    """
    c = {n: F.col(n) for n in ("phase", "platform", "name", "epoch", "step")}
    sets = [
        [c["phase"], c["name"], c["epoch"]],
        [c["phase"], c["platform"], c["name"], c["epoch"]],
        [c["phase"], c["name"], c["step"]],
        [c["phase"], c["platform"], c["name"], c["step"]],
    ]
    out = log.groupingSets(sets, *c.values()).agg(
        F.avg("value").alias("value"),
        F.count("value").alias("n"),
        F.grouping("platform").alias("_all"),
        F.grouping("step").alias("_epoch"),
    )
    series = F.when(F.col("_all") == 1, F.concat_ws("/", "phase", "name")).otherwise(
        F.concat_ws("/", F.concat_ws("_", "phase", "platform"), "name")
    )
    return out.select(
        series.alias("series"),
        F.when(F.col("_epoch") == 1, "epoch").otherwise("step").alias("grain"),
        F.coalesce(F.col("step"), F.col("epoch").cast("bigint")).alias("at"),
        "value",
        "n",
    )
