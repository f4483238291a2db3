"""Quality rules: robust multivariate outliers among documents of one language and source.

Five counts of each whole text become five transformed statistics. For each (lang, source), a
minimum-covariance-determinant estimate gives the centre and scatter of its clean majority, and a
document whose Mahalanobis distance from it is too large is rejected.

The estimate covers all rows. The deciles of each statistic cut a group into at most 10**5 cells, however
many rows it has, and one aggregation with map-side sums gives the moments of each cell. So neither a group's rows nor their
order meet in one task, and a group may hold any share of the corpus. Over a group's cells the search goes as it would over
rows: from several starts, concentration steps take the cells nearest to the present estimate, the last of them in part,
until they hold ``SUPPORT`` of the rows, and estimate again from their exact moments, until the determinant stops falling;
the least determinant counts. The scatter of the nearest half is then multiplied by the factor that makes it that of all
rows where these are normal.

A small group's estimate says little, so every estimate is drawn towards that of its language as if ``PRIOR_ROWS`` rows
more had come from there, and a language's towards that of all rows. That holds at every size, without a switch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlab.llm.store import slices, spread_join, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = ("log_words", "log_word_length", "symbol_root", "dup_line_root", "repeat_root")
#: Least spread of each statistic: differences below it mean nothing, and most texts have no symbols at all.
FLOORS = (0.35, 0.045, 0.045, 0.06, 0.2)
#: Share of a group that the estimate rests on: the least possible, so that nearly half of a group may be junk.
SUPPORT = 0.5
#: SUPPORT over the probability that chi-square with 7 degrees of freedom is below the SUPPORT quantile of that with 5.
CONSISTENCY = 1.912208
#: Rejects beyond the chi-square quantile, 5 degrees of freedom, of 1 - 1e-5.
MAX_DISTANCE2 = 30.86
#: Intervals of each statistic: its deciles cut a group into cells.
INTERVALS = 10
#: Least fall of a log-determinant that counts: less is the order of a sum.
LEAST_FALL = 1e-6
#: Random starts of the search, steps from each, and how many of the best go on until nothing falls.
STARTS, FIRST_STEPS, BEST = 30, 2, 4
#: So many rows' weight has the language in the estimate of a group, and the whole in that of a language.
PRIOR_ROWS = 25
#: Largest number of groups whose estimates, some 250 bytes each, are sent to every executor; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def _counts(data: bytes) -> tuple[int, int, int, int, int]:
    words, solid = data.split(), data.translate(None, _SPACE)
    lines = [line for line in data.split(b"\n") if line.strip()] if b"\n" in data else []
    repeated = 0
    if len(words) > 3:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(number) + ids[2:]
        _, inverse, n = np.unique(windows, return_inverse=True, return_counts=True)
        again = np.flatnonzero(n[inverse] > 1)
        if again.size:
            inside = np.zeros(len(words), bool)
            for k in range(3):
                inside[again + k] = True
            repeated = int(inside.sum())
    symbols = len(solid) - len(solid.translate(None, _SYMBOLS))
    return len(words), len(solid.decode()), symbols, len(lines) - len(set(lines)), repeated


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_counts(text: pa.Array) -> pa.Array:
    """The five counts of each whole text (a null text: zeros). Texts are taken from a batch a few megabytes at a time."""
    rows: list[tuple] = []
    for part in slices([pa.RecordBatch.from_arrays([text], ["text"])]):
        rows += [_counts(t) if t else (0, 0, 0, 0, 0) for t in part.column("text").cast(pa.binary()).to_pylist()]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 5)], list(COUNTS))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the five counts, base_failed and the five transformed statistics, named with an underscore."""
    c = {name: F.col(f"_counts.{name}") for name in COUNTS}
    words, chars = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["word_chars"], F.lit(1))
    stats = [F.log1p(c["n_words"]), F.log(chars / words), F.sqrt(c["n_symbols"] / chars), F.sqrt(c["n_dup_lines"] / words), F.sqrt(c["n_repeat_words"] / words)]
    out = docs.withColumn("_counts", text_counts(text))
    return out.select(
        *docs.columns,
        *(c[name].alias(f"_{name}") for name in COUNTS),
        ((c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])).alias("_base_failed"),
        *(s.alias(f"_{name}") for s, name in zip(stats, STATS, strict=True)),
    )


def _keys() -> list[Column]:
    """Of a row's (lang, source), its lang, and all; nulls are values of their own."""
    lang, source = (F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in ("lang", "source"))
    return [F.to_json(F.array(lang, source)), F.to_json(F.array(lang)), F.lit("[]")]


def _levels(rows: DataFrame) -> DataFrame:
    """Each row three times: for its (lang, source), its lang, and all."""
    return rows.select(F.posexplode(F.array(*_keys())).alias("_level", "_key"), *STATS)


_PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]


def _cells(levels: DataFrame) -> DataFrame:
    """_level, _key and, for each cell of a group, its rows n and the sums of the statistics and of their products."""
    deciles = ", ".join(f"{k / INTERVALS}D" for k in range(1, INTERVALS))
    marks = levels.groupBy("_level", "_key").agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"percentile_approx({s}, array({deciles}), 1000)").alias(f"q{i}") for i, s in enumerate(STATS)))
    marks = written(marks, "quality-marks")
    interval = lambda i, s: " + ".join(f"int({s} > q{i}[{k}])" for k in range(INTERVALS - 1))
    cell = " + ".join(f"{INTERVALS**i} * ({interval(i, s)})" for i, s in enumerate(STATS))
    sums = [f"sum({s}) AS s{i}" for i, s in enumerate(STATS)] + [f"sum({STATS[i]} * {STATS[j]}) AS p{i}_{j}" for i, j in _PAIRS]
    placed = joined_groups(levels, marks.drop("_level"), "_key", marks).withColumn("_cell", F.expr(cell))
    return placed.groupBy("_level", "_key", "_cell").agg(F.count(F.lit(1)).alias("n"), *map(F.expr, sums))


def joined_groups(rows: DataFrame, groups: DataFrame, key: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined to a table with one row for each group: sent to every executor if there are few groups, else by
    ``spread_join``. counts (written): the key and n, its rows."""
    if counts.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), key, how)
    return spread_join(rows, groups, key, F.monotonically_increasing_id(), how, counts)


def _moments(weight: np.ndarray, n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of cells, each taken by its weight."""
    total = weight @ n
    centre, scatter = weight @ sums / total, np.zeros((5, 5))
    for (i, j), x in zip(_PAIRS, weight @ products / total, strict=True):
        scatter[i, j] = scatter[j, i] = x - centre[i] * centre[j]
    return centre, scatter


def least_determinant(n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, scatter and log-determinant (of the floored scatter) of the SUPPORT of the rows with the least determinant."""
    n, half, means, floors = n.astype(float), np.ceil(SUPPORT * n.sum()), sums / n[:, None], np.diag(np.square(FLOORS))

    def nearest(centre: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        away = means - centre
        order = np.argsort(((away @ inverse) * away).sum(axis=1), kind="stable")
        weight = np.empty(len(n))
        weight[order] = np.clip((half - (np.cumsum(n[order]) - n[order])) / n[order], 0, 1)
        return weight

    def descend(weight: np.ndarray, steps: float) -> tuple[float, np.ndarray, tuple]:
        best = None
        while True:
            centre, scatter = _moments(weight, n, sums, products)
            logdet = float(np.linalg.slogdet(scatter + floors)[1])
            if best and (logdet > best[0] - LEAST_FALL or steps <= 0):
                return best if best[0] <= logdet else (logdet, weight, (centre, scatter))
            best, steps = (logdet, weight, (centre, scatter)), steps - 1
            weight = nearest(centre, np.linalg.inv(scatter + floors))

    ranked = np.argsort(means, axis=0, kind="stable")
    upto = np.cumsum(n[ranked], axis=0) / n.sum()
    low, middle, high = (np.array([means[ranked[min(np.searchsorted(upto[:, i], q), len(n) - 1), i], i] for i in range(5)]) for q in (0.16, 0.5, 0.84))
    starts = [descend(nearest(middle, np.diag(1 / (((high - low) / 2) ** 2 + np.square(FLOORS)))), np.inf)]
    rng, some = np.random.default_rng(0), []
    for _ in range(STARTS if len(n) > 6 else 0):
        weight = np.zeros(len(n))
        chosen = rng.choice(len(n), 6, replace=False, p=n / n.sum())
        weight[chosen] = 1 / n[chosen]
        centre, scatter = _moments(weight, n, sums, products)
        some.append(descend(nearest(centre, np.linalg.inv(scatter + floors)), FIRST_STEPS))
    starts += [descend(weight, np.inf) for _, weight, _ in sorted(some, key=lambda x: x[0])[:BEST]]
    logdet, _, (centre, scatter) = min(starts, key=lambda x: x[0])
    return centre, scatter, logdet


def _distance2(prefix: str, estimate: str) -> Column:
    away = [f"({prefix}{s} - {estimate}centre[{i}])" for i, s in enumerate(STATS)]
    return F.expr("greatest(" + " + ".join(f"{1 if i == j else 2} * {away[i]} * {away[j]} * {estimate}inverse[{5 * i + j}]" for i, j in _PAIRS) + ", 0D)")


def _main(prefix: str, estimate: str) -> Column:
    """The name of the statistic with the largest part in the squared distance: its deviation times that of its row of the inverse."""
    away = [f"({prefix}{s} - {estimate}centre[{i}])" for i, s in enumerate(STATS)]
    parts = [f"named_struct('part', {away[i]} * ({' + '.join(f'{estimate}inverse[{5 * i + j}] * {away[j]}' for j in range(5))}), 'name', '{s}')" for i, s in enumerate(STATS)]
    return F.expr(f"array_max(array({', '.join(parts)})).name")


_ESTIMATE = "_level int, _key string, rows bigint, centre array<double>, scatter array<double>, logdet double"


def fit(rows: DataFrame) -> DataFrame:
    """Estimates, one row for each (lang, source), each lang and all, as they are from their own rows; rows: lang,
    source and STATS, without those that failed the base rules. No rows: no estimates."""

    def search(cells: pa.Table) -> pa.Table:
        column = lambda names: np.column_stack([cells[c].to_numpy() for c in names])
        n = cells["n"].to_numpy()
        centre, scatter, logdet = least_determinant(n, column([f"s{i}" for i in range(5)]), column([f"p{i}_{j}" for i, j in _PAIRS]))
        return pa.table({"_level": cells["_level"][:1], "_key": cells["_key"][:1], "rows": pa.array([int(n.sum())], pa.int64()), "centre": [centre.tolist()], "scatter": [scatter.ravel().tolist()], "logdet": [logdet]})

    return written(_cells(_levels(rows)).groupBy("_level", "_key").applyInArrow(search, _ESTIMATE), "quality-estimates")


def _drawn(own: tuple, towards: tuple, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and scatters, drawn towards others by the weight of PRIOR_ROWS."""
    share = rows / (rows + PRIOR_ROWS)
    return tuple(share.reshape(-1, *[1] * (a.ndim - 1)) * a + (1 - share).reshape(-1, *[1] * (a.ndim - 1)) * b for a, b in zip(own, towards, strict=True))


def judges(estimates: DataFrame) -> DataFrame:
    """_key, rows, centre and inverse by which each (lang, source) is judged: drawn towards its language's and all."""
    names = ("rows", "centre", "scatter")
    of = lambda level, prefix: estimates.where(F.col("_level") == level).select(F.col("_key").alias(f"{prefix}key"), *(F.col(c).alias(f"{prefix}{c}") for c in names))
    lang = F.to_json(F.slice(F.from_json("_key", "array<string>"), 1, 1))
    joined = of(0, "_").withColumns({"wide_key": lang, "all_key": F.lit("[]")}).join(of(1, "wide_"), "wide_key").join(of(2, "all_"), "all_key")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            part = lambda p: (np.array(frame[f"{p}centre"].tolist()).reshape(-1, 5), np.array(frame[f"{p}scatter"].tolist()).reshape(-1, 5, 5))
            rows = lambda p: frame[f"{p}rows"].to_numpy(float)
            centre, scatter = _drawn(part("_"), _drawn(part("wide_"), part("all_"), rows("wide_")), rows("_"))
            inverse = np.linalg.inv(CONSISTENCY * scatter + np.diag(np.square(FLOORS)))
            yield pd.DataFrame({"_key": frame["_key"], "rows": frame["_rows"], "centre": list(centre), "inverse": list(inverse.reshape(-1, 25))})

    return joined.mapInPandas(each, "_key string, rows bigint, centre array<double>, inverse array<double>")


def verdicts(rows: DataFrame, estimates: DataFrame, max_distance2: float = MAX_DISTANCE2) -> DataFrame:
    """rows (lang, source, base_failed and STATS with prefix ``_``) with _distance2, _main (what it is due to most) and _kept.

    A row that failed the base rules is not kept; where nothing could be estimated, no other row is rejected.
    """
    found = written(judges(estimates), "quality-judges")
    by_key = found.select(F.col("_key").alias("_own_key"), F.struct("centre", "inverse").alias("_e"))
    counts = found.select(F.col("_key").alias("_own_key"), F.col("rows").alias("n"))
    out = joined_groups(rows.withColumn("_own_key", _keys()[0]), by_key, "_own_key", counts, "left")
    out = out.withColumns({"_distance2": _distance2("_", "_e."), "_main": _main("_", "_e.")}).drop("_e", "_own_key")
    return out.withColumn("_kept", ~F.col("_base_failed") & (F.coalesce("_distance2", F.lit(0.0)) <= max_distance2))


def _fitted(stats: DataFrame) -> DataFrame:
    return fit(stats.where("not _base_failed").select("lang", "source", *(F.col(f"_{s}").alias(s) for s in STATS)))


def judge(docs: DataFrame, max_distance2: float = MAX_DISTANCE2) -> DataFrame:
    """doc_id, the five counts, base_failed, distance2, reason and kept, one row for each row of docs.

    reason: "base" for the base rules, or the statistic that a rejection by distance is due to most; empty for what is kept.

    Null texts count as empty and fail the base rules. A null lang or source is a group of its own.
    Repeated rows are judged alike. Columns other than doc_id, text, lang and source are not read.
    """
    stats = written(with_statistics(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality-stats")
    out = verdicts(stats, _fitted(stats), max_distance2)
    reason = F.when(F.col("_base_failed"), "base").when(~F.col("_kept"), F.col("_main")).otherwise("")
    return out.select("doc_id", *(F.col(f"_{c}").alias(c) for c in COUNTS), F.col("_base_failed").alias("base_failed"), F.col("_distance2").alias("distance2"), reason.alias("reason"), F.col("_kept").alias("kept"))


def keep(docs: DataFrame, max_distance2: float = MAX_DISTANCE2) -> DataFrame:
    """The rows of docs that are kept, with their columns as they are.

    The counts of a text are computed twice, once to fit and once to filter: that is cheaper than to write
    all texts again, and needs no key for a row.
    """
    stats = written(with_statistics(docs.select("lang", "source", "text")).drop("text"), "quality-stats")
    rows = docs.select(F.struct("*").alias("_row")).select("_row", "_row.lang", "_row.source")  # no name can clash
    return verdicts(with_statistics(rows, "_row.text"), _fitted(stats), max_distance2).where("_kept").select("_row.*")
