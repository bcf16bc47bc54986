"""Raw CSV files to clean tables, master table, load files, price model, insights and report.

python -m nightledger --listings L.csv --calendar C.csv --reviews R.csv --out DIR
"""

from __future__ import annotations

import argparse
import datetime as dt
import os

from pyspark.sql import SparkSession

from nightledger.operators import audit
from nightledger.plans import insights, library, pricing
from nightledger.plans.warehouse import Warehouse
from nightledger.session import build_session
from nightledger.sources import files, tables


# Nights and reviews of listings that were dropped for lack of a price stay in their tables.
ALLOWED = {("calendar_daily", "listing_id in listings"), ("reviews", "listing_id in listings")}


def run(
    spark: SparkSession,
    paths: dict[str, str],
    out: str,
    as_of: str,
    allowed: set[tuple[str, str]] = frozenset(ALLOWED),
    model: bool = True,
) -> Warehouse:
    """Nothing is exported when a rule is broken that is not in ``allowed``; ``model`` also
    trains, scores and saves the price model."""
    w = Warehouse.of_files(spark, paths, as_of, root=os.path.join(out, "stages"))
    report = audit.gate_report(w.audited(), library.q16_month_coverage(w), w.counts())
    audit.enforce(report, set(allowed))
    files.export_tables(w.tables(), os.path.join(out, "load"))
    tables.write_csv(w.rejected(), os.path.join(out, "rejected"))
    if model:
        pricing.train_and_score(w, out)
    pack = insights.build(w["master"], w["monthly_agg"])
    tables.write_csv(pack.drop("position"), os.path.join(out, "business_insights"))
    lines = insights.report_lines(pack, insights.market_totals(w["master"]))
    insights.write_report(lines, os.path.join(out, "report"))
    return w


def main() -> None:
    parser = argparse.ArgumentParser(prog="nightledger", description=__doc__)
    for name in ("listings", "calendar", "reviews", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--as-of", default=dt.date.today().isoformat())
    parser.add_argument(
        "--allow", action="append", default=[], metavar="TABLE:RULE", help="rule that may be broken"
    )
    parser.add_argument("--skip-model", action="store_true", help="do not train the price model")
    args = parser.parse_args()
    allowed = ALLOWED | {tuple(x.split(":", 1)) for x in args.allow}
    paths = {name: getattr(args, name) for name in ("listings", "calendar", "reviews")}
    run(build_session(), paths, args.out, args.as_of, allowed, not args.skip_model)


if __name__ == "__main__":
    main()
