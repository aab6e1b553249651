"""``python -m millrace STEP --data DIR --out DIR [--config FILE]``: the jobs of ``plans.pipelines``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from millrace.plans import pipelines
from millrace.plans.config import load_settings


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="millrace")
    parser.add_argument("step", choices=("prepare", "train", "evaluate", "predict", "run-all", "profile"))
    parser.add_argument("--data", help="folder of the tables")
    parser.add_argument("--out", required=True, help="folder of the results")
    parser.add_argument("--config", help="settings as JSON or YAML")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    settings = load_settings(spark, a.config)
    if a.step in ("prepare", "run-all", "profile") and not a.data:
        parser.error(f"{a.step} needs --data")
    if a.step == "prepare":
        pipelines.prepare(spark, a.data, a.out, settings)
    elif a.step == "train":
        pipelines.train(spark, a.out, settings)
    elif a.step == "evaluate":
        pipelines.evaluate(spark, a.out, settings).show(truncate=False)
    elif a.step == "predict":
        pipelines.predict(spark, a.out, settings)
    elif a.step == "profile":
        pipelines.profile(spark, a.data, a.out)
    else:
        pipelines.run_all(spark, a.data, a.out, settings).show(truncate=False)


if __name__ == "__main__":
    main()
