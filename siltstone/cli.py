"""python -m siltstone.cli gold|coverage|correlations|regional: the jobs over landed files or a written matrix."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.operators import gold, jobs
from siltstone.session import session
from siltstone.sources import rules, sinks, tree


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="python -m siltstone.cli")
    sub = out.add_subparsers(dest="job", required=True)
    build = sub.add_parser("gold", help="landed statistics and extracted news to the wide matrix")
    build.add_argument("--bronze-root", required=True)
    build.add_argument("--news", help="path of the news features' table; without it the matrix has no news")
    build.add_argument("--crosswalk", help="reviewed labels, a JSON lines file of source_column and feature")
    build.add_argument("--monthly", action="store_true")
    for name in ("coverage", "correlations", "regional"):
        sub.add_parser(name).add_argument("--input", required=True, help="the written matrix")
    corr = sub.choices["correlations"]
    corr.add_argument("--targets", nargs="+", default=["rail_investment", "rail_investment_pps"])
    corr.add_argument("--min-obs", type=int, default=30)
    for flag in ("by-country", "panel", "country-only"):
        corr.add_argument(f"--{flag}", action="store_true")
    sub.choices["regional"].add_argument("--money", default="rail_investment")
    for p in sub.choices.values():
        p.add_argument("--out", required=True, help="folder of the results")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session("siltstone")
    if args.job == "gold":
        facts = tree.stats_from_tree(spark, args.bronze_root)
        known = spark.read.schema(schemas.CROSSWALK).json(args.crosswalk) if args.crosswalk else None
        mapped = gold.crosswalk(facts, rules.label_crosswalk(facts, known))
        news = sinks.load(spark, schemas.NEWS_FEATURE, args.news) if args.news else spark.createDataFrame([], schemas.NEWS_FEATURE)
        from siltstone.functions.columns import news_time

        day = news_time(F.col("published_date"))
        news = news.withColumns({"year": F.year(day).cast("long"), "month": F.month(day).cast("long"), "money": F.col("monetary_amount_eur")})
        found = jobs.run_gold(mapped, news, rules.FEATURES, args.out, args.monthly)
    else:
        matrix = spark.read.parquet(args.input)
        if args.job == "coverage":
            found = jobs.run_coverage(matrix, args.out)
        elif args.job == "correlations":
            found = jobs.run_correlations(matrix, args.targets, args.out, args.by_country, args.panel, args.country_only, args.min_obs)
        else:
            found = jobs.run_regional(matrix, args.out, args.money)
    print(json.dumps(found, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
