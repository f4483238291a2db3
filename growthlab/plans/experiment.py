"""Settings of experiments: the last row of each workbook's sheet that speaks of each, found by one aggregation over all rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlab.functions import normalized_id, number
from growthlab.functions.growth import DEFAULT_THRESHOLD

# The words by which the first cell of a row names each setting.
NAMED_BY = {"control_group": ("control", "group"), "threshold": ("responder", "threshold"), "excluded": ("exclude",)}
#: A setting that also holds without values, and then is empty.
MAY_BE_EMPTY = "excluded"


@dataclass(frozen=True)
class ExperimentConfig:
    """control_group is read and kept, and no result depends on it. excluded: ids as the sheet has them."""

    control_group: str | None = None
    threshold: float = DEFAULT_THRESHOLD
    excluded: tuple[str, ...] = ()


def _names(setting: str) -> Column:
    """Whether the row's first cell holds all words of the setting, in any case."""
    title = F.lower(F.get("cells", F.lit(0))["text"])
    held = [title.contains(word) for word in NAMED_BY[setting]]
    return F.coalesce(held[0] & held[-1], F.lit(False))


def settings(rows: DataFrame, *keys: str) -> DataFrame:
    """A row for each value of the keys, or one of all rows: the values of the last row for each setting (null: none speaks of
    it), and wrong_threshold, a threshold of any row that is no number. rows: _row and cells (array of text and kind)."""
    values = F.filter(F.transform(F.expr("slice(cells, 2, greatest(size(cells) - 1, 0))"), lambda c: c["text"]), lambda t: t.isNotNull())
    found = rows.select(*keys, "_row", values.alias("values"), *(_names(s).alias(s) for s in NAMED_BY))
    counts = {s: F.col(s) & ((F.size("values") > 0) | F.lit(s == MAY_BE_EMPTY)) for s in NAMED_BY}
    last = [F.max_by(F.when(counts[s], F.col("values")), F.when(counts[s], F.col("_row"))).alias(s) for s in NAMED_BY]
    wrong = F.when(counts["threshold"] & number(F.get("values", F.lit(0))).isNull(), F.get("values", F.lit(0)))
    chosen = found.groupBy(*keys).agg(*last, F.max(wrong).alias("wrong_threshold"))
    ids = F.filter(F.flatten(F.transform("excluded", lambda v: F.transform(F.split(v, ","), lambda x: F.trim(x)))), lambda x: x != "")
    first = lambda s: F.get(s, F.lit(0))
    return chosen.select(*keys, F.trim(first("control_group")).alias("control_group"), number(first("threshold")).alias("threshold"), ids.alias("excluded"), "wrong_threshold")


def settings_of_books(rows: DataFrame) -> DataFrame:
    """_path, control_group, threshold and excluded (ids as the sheet has them) of each workbook. rows: path, _row and cells. A
    threshold that is no number fails the query."""
    found = settings(rows.withColumnRenamed("path", "_path"), "_path")
    message = F.concat(F.lit("the responder threshold of "), F.col("_path"), F.lit(" is no number: "), F.col("wrong_threshold"))
    threshold = F.when(F.col("wrong_threshold").isNotNull(), F.raise_error(message).cast("double")).otherwise(F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)))
    return found.select("_path", "control_group", threshold.alias("threshold"), F.coalesce("excluded", F.array().cast("array<string>")).alias("excluded"))


def excluded_by_book(config: DataFrame) -> DataFrame:
    """_path and mouse (normalised): the ids that the settings of each workbook exclude."""
    return config.select("_path", F.explode("excluded").alias("id")).select("_path", normalized_id(F.col("id")).alias("mouse"))


def with_thresholds(wide: DataFrame, config: DataFrame) -> DataFrame:
    """wide with the column threshold: that of the row's workbook, or the default where its settings say nothing."""
    return wide.join(config.select("_path", "threshold"), "_path", "left").fillna({"threshold": DEFAULT_THRESHOLD}).select(*wide.columns, "threshold")


def experiment_of(rows: DataFrame) -> ExperimentConfig:
    """The settings of a sheet's rows. A threshold that is no number is an error."""
    found = settings(rows).first()
    if found["wrong_threshold"] is not None:
        raise ValueError(f"the responder threshold is no number: {found['wrong_threshold']!r}")
    threshold = DEFAULT_THRESHOLD if found["threshold"] is None else found["threshold"]
    return ExperimentConfig(found["control_group"], threshold, tuple(found["excluded"] or ()))
