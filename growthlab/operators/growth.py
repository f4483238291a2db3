"""Longitudinal analysis: long table, summaries, growth of each subject, responders.

Where several workbooks were read, _path tells their rows apart: it is one of a subject's ids and one of the keys of every summary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthlab.functions import change, classify_response, percent_growth, responder_percent, sd, sem
from growthlab.functions.growth import DEFAULT_THRESHOLD

# Why a subject can't be classified.
NO_BASELINE = "Missing Day 0 value. Mouse cannot be classified."
NO_FOLLOW_UP = "No post-baseline measurements. Mouse cannot be classified."
ZERO_BASELINE = "Day 0 value is zero. Mouse cannot be classified."

BOOK = "_path"
IDS = (BOOK, "_row", "grp", "mouse")
GROWTH = ("initial_tv", "final_tv", "final_day", "change", "percent_growth", "response")


def to_long(wide: DataFrame, days: Sequence[int]) -> DataFrame:
    """A row (ids, day, tv) for each measurement that is there; wide has a column for each day, named by it."""
    ids = [c for c in IDS if c in wide.columns]
    long = wide.unpivot(ids, [F.col(f"`{d}`") for d in days], "day", "tv")
    return long.where("tv is not null and not isnan(tv)").withColumn("day", F.col("day").cast("int"))


def means_in_order(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """keys and the mean of value, under its name: the sum of its doubles one by one in the order of the column order (equal ones
    by value), whatever the files, partitions and tasks are. One exchange and sort of the rows by keys, where a large group
    spills."""
    by = Window.partitionBy(*keys).orderBy(order, value)
    added = F.sum(F.col(value).cast("double")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.select(*keys, value, added.alias("_added"), F.row_number().over(by).alias("_place"))
    return placed.groupBy(*keys).agg(F.try_divide(F.max_by("_added", "_place"), F.count(value)).alias(value))


def summary(long: DataFrame, *keys: str) -> DataFrame:
    """Mean, SD, n and SEM of tv for each key."""
    return long.groupBy(*keys).agg(F.avg("tv").alias("mean_tv"), sd("tv").alias("sd"), F.count("tv").alias("n"), sem("tv").alias("sem"))


def _book(df: DataFrame) -> list[str]:
    return [BOOK] if BOOK in df.columns else []


def general_summary(long: DataFrame) -> DataFrame:
    """_path (if there), grp, day, mean_tv, sd, n, sem: of all measurements, also of subjects that can't be classified."""
    return summary(long, *_book(long), "grp", "day")


def _judged(found: DataFrame, ids: Sequence[str], threshold: float | Column, on_zero_baseline: str, carried: Sequence[str] = ()) -> DataFrame:
    """ids, the columns of growth and issue (null: growth holds) of rows with initial_tv, final_tv, final_day and follow_ups."""
    initial, final = F.col("initial_tv"), F.col("final_tv")
    issue = F.when(initial.isNull(), NO_BASELINE).when(F.col("follow_ups") == 0, NO_FOLLOW_UP)
    if on_zero_baseline == "issue":
        issue = issue.when(initial == 0, ZERO_BASELINE)
    judged = found.withColumn("issue", issue)
    there = lambda c: F.when(F.col("issue").isNull(), c)  # noqa: E731  a zero baseline matters only where growth holds
    judged = judged.withColumns({"change": there(change(initial, final)), "percent_growth": there(percent_growth(initial, final, on_zero_baseline))})
    return judged.select(*ids, *GROWTH[:-1], there(classify_response(F.col("percent_growth"), threshold)).alias("response"), "issue", *carried)


def growth_and_errors(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(growth, errors) of outcomes: each row is in one of them."""
    ids = [c for c in outcomes.columns if c not in (*GROWTH, "issue")]
    return outcomes.where("issue is null").drop("issue"), outcomes.where("issue is not null").select(*ids, "issue")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """num_mice_analyzed and num_errors: one row, one action."""
    return outcomes.agg(F.count_if(F.col("issue").isNull()).alias("num_mice_analyzed"), F.count_if(F.col("issue").isNotNull()).alias("num_errors"))


def _of_row(days: Sequence[int]) -> dict[str, Column]:
    """What a wide row says of its subject's growth."""
    value = {d: F.when(~F.isnan(F.col(f"`{d}`")), F.col(f"`{d}`")) for d in days}
    latest = sorted(days, reverse=True)
    return {
        "initial_tv": value[0],
        "final_tv": F.coalesce(*(value[d] for d in latest)),
        "final_day": F.coalesce(*(F.when(value[d].isNotNull(), F.lit(d)) for d in latest)),
        "follow_ups": sum((value[d].isNotNull().cast("int") for d in days if d != 0), F.lit(0)),
    }


def outcomes_from_wide(wide: DataFrame, days: Sequence[int], threshold: float | Column = DEFAULT_THRESHOLD, on_zero_baseline: str = "error") -> DataFrame:
    """Growth or issue of each row of wide. Last values are found within the row: no shuffle. threshold: a number, or a column
    of wide where workbooks have their own."""
    ids = [c for c in IDS if c in wide.columns]
    found = wide.withColumns(_of_row(days))
    return _judged(found, ids, threshold, on_zero_baseline)


def growth_states(long: DataFrame, ids: Sequence[str] | None = None) -> DataFrame:
    """ids, initial_tv, final_day, final_tv and follow_ups of each subject of long, as states that ``merged_states`` puts together:
    measurements of a month can be added to what was kept of those before. Of several values of one day the greatest
    counts. Rows without a value keep a subject that has no other."""
    ids = list(ids) if ids else [c for c in IDS if c in long.columns]
    value = F.when(~F.isnan("tv"), F.col("tv"))
    day = F.when(value.isNotNull(), F.col("day"))
    last = F.max(F.when(value.isNotNull(), F.struct("day", value.alias("tv"))))
    found = long.groupBy(*ids).agg(F.max(F.when(day == 0, value)).alias("initial_tv"), last.alias("last"), F.count_if(day != 0).alias("follow_ups"))
    return found.select(*ids, "initial_tv", F.col("last.day").alias("final_day"), F.col("last.tv").alias("final_tv"), "follow_ups")


def merged_states(*states: DataFrame) -> DataFrame:
    """The states of the measurements of all of them, by one aggregation with map-side parts. Each measurement is to be in one only."""
    one, *others = states
    for other in others:
        one = one.unionByName(other)
    ids = [c for c in one.columns if c not in ("initial_tv", "final_day", "final_tv", "follow_ups")]
    last = F.max(F.when(F.col("final_day").isNotNull(), F.struct("final_day", "final_tv")))
    found = one.groupBy(*ids).agg(F.max("initial_tv").alias("initial_tv"), last.alias("last"), F.sum("follow_ups").alias("follow_ups"))
    return found.select(*ids, "initial_tv", "last.final_day", "last.final_tv", "follow_ups")


def outcomes_from_states(states: DataFrame, threshold: float | Column = DEFAULT_THRESHOLD, on_zero_baseline: str = "error") -> DataFrame:
    """Growth or issue of each subject of states."""
    ids = [c for c in states.columns if c not in ("initial_tv", "final_day", "final_tv", "follow_ups")]
    return _judged(states, ids, threshold, on_zero_baseline)


def outcomes_from_long(long: DataFrame, ids: Sequence[str] | None = None, threshold: float = DEFAULT_THRESHOLD, on_zero_baseline: str = "error") -> DataFrame:
    """Growth or issue of each ids' measurements, by default of each _row where there is one; one aggregation
    with map-side parts. Rows without a value keep a subject that has no other among the results."""
    return outcomes_from_states(growth_states(long, ids), threshold, on_zero_baseline)


def growth_from_wide(wide: DataFrame, days: Sequence[int], threshold: float = DEFAULT_THRESHOLD, on_zero_baseline: str = "error") -> tuple[DataFrame, DataFrame]:
    """(growth, errors) of a wide table."""
    return growth_and_errors(outcomes_from_wide(wide, days, threshold, on_zero_baseline))


def growth_from_long(long: DataFrame, ids: Sequence[str] | None = None, threshold: float = DEFAULT_THRESHOLD, on_zero_baseline: str = "error") -> tuple[DataFrame, DataFrame]:
    """(growth, errors) of a long table."""
    return growth_and_errors(outcomes_from_long(long, ids, threshold, on_zero_baseline))


def response_summary(growth: DataFrame) -> DataFrame:
    """_path (if there), grp, responders, non_responders, total (of both) and responder_percent; other responses only make a group appear."""
    keys = [*_book(growth), "grp"]
    counts = growth.groupBy(*keys).agg(F.count_if(F.col("response") == "Responder").alias("responders"), F.count_if(F.col("response") == "Non-responder").alias("non_responders"))
    total = F.col("responders") + F.col("non_responders")
    return counts.select(*keys, "responders", "non_responders", total.alias("total"), responder_percent(F.col("responders"), total).alias("responder_percent"))


def responder_tv_summary(long: DataFrame, growth: DataFrame) -> DataFrame:
    """_path (if there), grp, response, day and the summary. A subject listed twice counts each measurement twice, as a join does.

    Responses are one row for each subject: Spark broadcasts them if small and else sorts both sides.
    """
    keys = [*_book(long), "grp", "mouse"]
    return summary(long.join(growth.select(*keys, "response"), keys), *_book(long), "grp", "response", "day")


def responder_tv_summary_from_wide(wide: DataFrame, days: Sequence[int], threshold: float | Column = DEFAULT_THRESHOLD, on_zero_baseline: str = "error") -> DataFrame:
    """responder_tv_summary of a wide table, in one scan and without a join.

    A row's response is found within the row. Rows of one subject meet in one exchange by its ids, and each learns how many of them have
    each response; its measurements then count once for each of those, as in a join. Nothing else is exchanged but the parts
    of the summary.
    """
    keys = [*_book(wide), "grp", "mouse"]
    values = F.struct(*(F.col(f"`{d}`").alias(str(d)) for d in days)).alias("values")
    placed = _judged(wide.select("*", values).withColumns(_of_row(days)), keys, threshold, on_zero_baseline, ["values"])
    kinds, subject = ("Responder", "Non-responder", "Unclassified"), Window.partitionBy(*keys)
    times = placed.withColumn("times", F.array(*(F.count_if(F.col("response") == k).over(subject) for k in kinds)))
    each = F.flatten(F.array(*(F.array_repeat(F.lit(k), F.get("times", F.lit(n)).cast("int")) for n, k in enumerate(kinds))))
    rows = times.select(*keys, "values", F.explode(each).alias("response"))
    long = rows.select(*keys, "response", *(F.col(f"values.`{d}`").alias(str(d)) for d in days)).unpivot([*keys, "response"], [F.col(f"`{d}`") for d in days], "day", "tv")
    return summary(long.where("tv is not null and not isnan(tv)").withColumn("day", F.col("day").cast("int")), *_book(wide), "grp", "response", "day")
