"""Command line for schedulers: run one chain against a lakehouse root.

    spark-submit paylake/__main__.py realtime  --root s3://bucket/lake
    spark-submit paylake/__main__.py medallion --root s3://bucket/lake [--now "2024-01-30 12:00:00"]
    spark-submit paylake/__main__.py warehouse --root s3://bucket/lake   (lane-B bronze -> warehouse silver -> gold days)
    spark-submit paylake/__main__.py merge     --root s3://bucket/lake   (background silver merge)
    spark-submit paylake/__main__.py fold      --root s3://bucket/lake --layer bronze_a --checkpoint s3://bucket/ck/bronze_a
    spark-submit paylake/__main__.py vacuum    --root s3://bucket/lake [--keep 2]   (frees replaced folders)
    spark-submit paylake/__main__.py retention --root s3://bucket/lake --as-of 2024-04-15

(``python -m paylake ...`` does the same with a local session.)

The process exits non-zero when a gate or data test fails, so the scheduler
stops what follows (T8).
"""

from __future__ import annotations

import argparse
import json
import sys

from paylake.operators.lifecycle import apply_partition_window, apply_retention, fold_batches
from paylake.plans.chains import merge_silver, run_medallion, run_realtime, run_warehouse
from paylake.session import get_session
from paylake.sources import generations
from paylake.sources.tables import LAYERS, Lakehouse


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="paylake")
    parser.add_argument("command", choices=["realtime", "medallion", "warehouse", "merge", "fold", "vacuum", "retention"])
    parser.add_argument("--root", required=True, help="lakehouse root directory")
    parser.add_argument("--now", default=None, help="reference time (default: wall clock)")
    parser.add_argument("--as-of", default=None, help="day for retention / partition window")
    parser.add_argument("--layer", default="bronze_a", choices=["bronze_a", "bronze_b"],
                        help="fold: the stream-written layer (ingestion logs are stream sources and stay as they are)")
    parser.add_argument("--checkpoint", default=None, help="fold: the stream's checkpoint (closed batches fold)")
    parser.add_argument("--keep", type=int, default=2, help="vacuum: pointers that readers may still follow")
    parser.add_argument("--incremental-gold", action="store_true",
                        help="medallion: refresh only the days the sync rewrote")
    args = parser.parse_args(argv)

    spark = get_session(app=f"paylake-{args.command}")
    lake = Lakehouse(args.root)
    try:
        if args.command == "realtime":
            result = run_realtime(spark, lake, now=args.now)
        elif args.command == "medallion":
            result = run_medallion(spark, lake, now=args.now, incremental_gold=args.incremental_gold)
        elif args.command == "warehouse":
            result = run_warehouse(spark, lake)
        elif args.command == "fold":
            if not args.checkpoint:
                parser.error("fold needs --checkpoint")
            result = fold_batches(spark, lake.path(args.layer), args.checkpoint)
        elif args.command == "vacuum":
            result = {layer: generations.vacuum(spark, lake.path(layer), args.keep) for layer in LAYERS}
        elif args.command == "merge":
            result = {"rows_kept": merge_silver(spark, lake)}
        else:
            if not args.as_of:
                parser.error("retention needs --as-of")
            result = {"bronze_a": apply_retention(spark, lake.path("bronze_a"), args.as_of),
                      "silver_payments_dropped": apply_partition_window(
                          spark, lake.path("silver_payments"), args.as_of)}
    except RuntimeError as err:          # a failed gate or data test
        print(json.dumps({"command": args.command, "failed": str(err)}))
        return 1
    print(json.dumps({"command": args.command, "result": result}, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
