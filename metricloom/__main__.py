"""``python -m metricloom context.json --config-dir DIR``: prints the response."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import api


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="metricloom", description="Computes the metrics that a request context asks for.")
    parser.add_argument("context", help="a JSON file")
    parser.add_argument("--config-dir", required=True, help="folder of kpis/ and models/")
    parser.add_argument("--log-dir", help="folder for a log of the plan")
    parser.add_argument("--validate", action="store_true", help="plan only")
    args = parser.parse_args(arguments)
    context = json.loads(Path(args.context).read_text())
    spark = SparkSession.getActiveSession() or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.validate:
        result = api.validate(context, spark=spark, config_dir=args.config_dir)
    else:
        result = api.compute(context, spark=spark, config_dir=args.config_dir, log_dir=args.log_dir)
    print(json.dumps(result, indent=2, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
