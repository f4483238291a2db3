"""Times the library's queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: medians of warm runs, as one JSON line.

``value`` sums the registered queries that every round has timed. Beside them stand, under names of their own, the operators over tables
that are written once (``over_written``: what the operator itself takes, without making its input), and training-data operators
(``llm``) where they are there.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from growthlab import operators as O
from growthlab.plans import queries as own
from growthlab.sources import scratch

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
HEADLINE = ("general_summary", "mouse_growth", "mouse_growth_wide", "response_summary", "responder_tv_summary", "wide_to_long", "annotate_day04", "normalize_mouse_id", "coerce_numeric", "bmi", "dilution")


#: Training-data operators of one pass each.
LLM = ("op6_hash_tree_shards", "op8_link_graph_filter", "op11_token_counts", "op12_fill_in_middle", "op13_cross_tokenizer_alignment")


def median(make, runs: int = RUNS) -> float:
    taken = []
    for _ in range(runs + 1):  # the first compiles
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - start)
    return round(statistics.median(taken[1:]), 4)


def over_written(spark: SparkSession) -> dict[str, float]:
    """The operators over a long and a wide table in Parquet."""
    folder = scratch(spark, "bench")
    own._obs(spark, SF_DIR).write.parquet(f"{folder}/long")
    own._wide(own._obs(spark, SF_DIR)).write.parquet(f"{folder}/wide")
    long, sheet = spark.read.parquet(f"{folder}/long"), spark.read.parquet(f"{folder}/wide")
    days = own.DAYS
    wide = O.clean_wide(sheet, [(d, str(d)) for d in days])
    return {
        "wide_to_long": median(lambda: O.to_long(wide, days)),
        "mouse_growth": median(lambda: O.growth_from_long(long)[0]),
        "mouse_growth_wide": median(lambda: O.growth_from_wide(wide, days)[0]),
        "responder_tv_summary": median(lambda: O.responder_tv_summary(O.to_long(wide, days), O.growth_from_wide(wide, days)[0])),
        "responder_tv_from_wide": median(lambda: O.responder_tv_summary_from_wide(wide, days)),
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {name: median(lambda name=name: own.QUERIES[name](spark, SF_DIR)) for name in HEADLINE}
    out = {"metric": f"sum of medians of {RUNS} warm runs", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "over_written": over_written(spark)}
    try:
        from growthlab.llm import queries as llm
    except ImportError:
        llm = None
    if llm:
        out["llm"] = {name: median(lambda name=name: llm.QUERIES[name](spark, SF_DIR), 2) for name in LLM}
    print(json.dumps(out | {"sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
