"""Command line: volume, annotate, check, growth, bmi, dilution."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from glob import glob
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from growthlab import functions as G
from growthlab.sources.files import has_scheme


def _workbook(text: str) -> str:
    path = text.strip()
    if not path:
        raise argparse.ArgumentTypeError("a path is needed")
    if Path(path).suffix.lower() != ".xlsx":
        raise argparse.ArgumentTypeError("an .xlsx workbook is needed; save one in the old format .xls as .xlsx")
    if not has_scheme(path) and not glob(path):
        raise argparse.ArgumentTypeError(f"no file {path}")
    return path


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="growthlab", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("volume", help="volume of one tumour; what is left out is asked for, the length first")
    one.add_argument("length", type=float, nargs="?")
    one.add_argument("width", type=float, nargs="?")
    one = commands.add_parser("annotate", help="volumes beside the rows of a workbook")
    one.add_argument("path", type=_workbook)
    one.add_argument("--dialect", choices=("day04", "day02"), default="day04")
    one = commands.add_parser("check", help="which of the workbooks that a quoted pattern names can't be analysed, and why")
    one.add_argument("path", type=_workbook)
    one = commands.add_parser("growth", help="longitudinal analysis of a workbook, or of all that a quoted pattern names")
    one.add_argument("path", type=_workbook)
    one.add_argument("--output-dir", default="output")
    one.add_argument("--on-zero-baseline", choices=("error", "issue"), default="error")
    one = commands.add_parser("bmi", help="body-mass index")
    one.add_argument("kg", type=float)
    one.add_argument("m", type=float)
    one = commands.add_parser("dilution", help="C1 * V1 = C2 * V2; leave the unknown out")
    for name in ("c1", "v1", "c2", "v2"):
        one.add_argument(f"--{name}", type=float)
    return parser


def main(argv: Sequence[str] | None = None) -> int:
    from growthlab.plans import analyze, annotate_workbook, sheet_issues

    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("growthlab").getOrCreate()
    if args.command == "volume":
        length, width = (float(input(f"{name}: ")) if value is None else value for name, value in (("Length", args.length), ("Width", args.width)))
        row = spark.createDataFrame([(length, width)], "l double, w double")
        if width > length:
            print("Error: Width cannot be greater than length.")
            return 1
        print(f"Tumor volume is: {row.select(G.tumor_volume(F.col('l'), F.col('w'))).first()[0]}")
    elif args.command == "annotate":
        path, errors = annotate_workbook(spark, args.path, args.dialect)
        print(f"{path}: " + ("one or more errors were found, see the Error column" if errors else "no errors"))
    elif args.command == "check":
        wrong = 0
        for row in sheet_issues(spark, args.path).where("issue is not null").orderBy("_path").toLocalIterator():
            wrong += 1
            print(f"{row['_path']}: {row['issue']}")
        print(f"{wrong} workbooks can't be analysed" if wrong else "all workbooks can be analysed")
        return int(wrong > 0)
    elif args.command == "growth":
        made = analyze(spark, args.path, args.output_dir, args.on_zero_baseline)
        print("Analysis completed.", *(f"{name}: {value}" for name, value in vars(made).items()), sep="\n")
    elif args.command == "bmi":
        value = G.bmi(F.col("kg"), F.col("m"))
        row = spark.createDataFrame([(args.kg, args.m)], "kg double, m double").select(G.bmi_error(F.col("kg"), F.col("m")).alias("e"), value.alias("v"), G.bmi_category(value).alias("c")).first()
        print(row["e"] or f"Your BMI: {row['v']}\nCategory: {row['c']}")
        return int(bool(row["e"]))
    else:
        given = {n: getattr(args, n) for n in ("c1", "v1", "c2", "v2")}
        unknown = [n for n, v in given.items() if v is None]
        if len(unknown) != 1:
            print("Error: leave exactly one of the four out")
            return 1
        choice = list(given).index(unknown[0]) + 1
        columns = [F.lit(choice), *(F.lit(v).cast("double") for v in given.values())]
        row = spark.range(1).select(G.dilution_error(*columns).alias("e"), G.dilution(*columns).alias("v")).first()
        print(row["e"] or f"{unknown[0].upper()} = {row['v']}")
        return int(bool(row["e"]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
