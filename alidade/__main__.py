"""Command line: generate, screen, score on held-out dates, recompute, seal, verify and review over the files of a panel.

    python -m alidade PANEL --fields total mean --until 2022-06-01 --store STORE --name 2022-06

Prints one JSON object. Nothing is sealed without --store, or if nothing passes. The driver holds a row a factor, pair or factor and year.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from alidade.operators.audit import annual_review, verify_freeze
from alidade.plans.grammar import generate
from alidade.plans.mining import Thresholds, held_out, labelled_values, screen, seal
from alidade.sources.tables import read_panel


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="alidade", description="Mines factors on a date-by-instrument panel.")
    parser.add_argument("panel", help="files with instrument, dt and the fields")
    parser.add_argument("--kind", default="parquet", choices=["parquet", "orc", "csv", "json"])
    parser.add_argument("--fields", nargs="+", required=True, help="the first is the one whose forward return is the label")
    parser.add_argument("--count", type=int, default=24, help="definitions to generate")
    parser.add_argument("--seed", type=int, default=1)
    parser.add_argument("--until", required=True, help="last date of screening; later ones are held out")
    parser.add_argument("--least-t", type=float, default=2.0)
    parser.add_argument("--most-false", type=float, default=1.0, help="expected share of chance among what passes")
    parser.add_argument("--review-after", type=int, help="review each later year against the years up to this one")
    parser.add_argument("--store", help="folder of freezes")
    parser.add_argument("--name", default="first", help="name of the freeze")
    given = parser.parse_args(argv)

    spark = spark or SparkSession.builder.appName("alidade").getOrCreate()
    panel, label = read_panel(spark, given.panel, given.fields, given.kind), given.fields[0]
    found = screen(panel, generate(given.fields, given.count, given.seed), given.until, Thresholds(least_t=given.least_t, most_false=given.most_false), label_field=label)
    out: dict = {"screened": len(found.statistics), "accepted": found.accepted}
    if found.accepted:
        out["held_out"] = [r.asDict() for r in held_out(panel, found.accepted, given.until, label).collect()]
        if given.review_after is not None:
            values = labelled_values(panel, found.accepted, label)
            out["review"] = [r.asDict() for r in annual_review(values, given.review_after).orderBy("factor_id", "year").collect()]
        if given.store:
            seal(panel, found.accepted, given.store, given.name, given.seed)
            out["intact"] = not verify_freeze(spark, given.store, given.name).where(~F.col("intact")).limit(1).count()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
