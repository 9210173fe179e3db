"""``python -m twinlake train|infer|resolve|validate``: the jobs of :mod:`twinlake.plans.jobs` over files."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from twinlake.plans import jobs
from twinlake.sources.shipping import ship


def _share(text: str) -> float:
    x = float(text)
    if not 0 <= x <= 1:
        raise argparse.ArgumentTypeError("must lie in [0, 1]")
    return x


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="twinlake", description=__doc__)
    sub = parser.add_subparsers(dest="job", required=True)
    t = sub.add_parser("train", help="fit and calibrate a matcher")
    t.add_argument("--data", required=True)
    t.add_argument("--models", required=True)
    t.add_argument("--splits")
    t.add_argument("--n-train", type=int, default=35_000)
    t.add_argument("--n-dev", type=int, default=10_000)
    t.add_argument("--budget", type=int, default=60)
    t.add_argument("--fixed-budget", action="store_true", help="the same budget for every record")
    t.add_argument("--base-features", action="store_true", help="without the extra features")
    t.add_argument("--negatives", type=int, default=10_000)
    t.add_argument("--head", type=int, help="targets in the pool beside the needed ones; all if not given")
    t.add_argument("--rounds", type=int, default=50)
    t.add_argument("--depth", type=int, default=6)
    i = sub.add_parser("infer", help="link the sources of a folder")
    i.add_argument("--data", required=True)
    i.add_argument("--models", required=True)
    i.add_argument("--output", required=True)
    i.add_argument("--scores")
    r = sub.add_parser("resolve", help="one owner for each target")
    r.add_argument("--matching", required=True)
    r.add_argument("--scores", required=True)
    r.add_argument("--output", required=True)
    r.add_argument("--winning-probability", type=_share, required=True)
    r.add_argument("--conflict-margin", type=_share, required=True)
    v = sub.add_parser("validate", help="check result files; exits with 1 if anything is found")
    v.add_argument("--matching", required=True)
    v.add_argument("--candidate")
    v.add_argument("--data", required=True)
    v.add_argument("--check-ids", action="store_true")
    return parser


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(arguments)
    spark = ship(spark or SparkSession.builder.appName(f"twinlake {a.job}").getOrCreate())
    if a.job == "train":
        s = jobs.train(spark, a.data, a.models, splits=a.splits, n_train=a.n_train, n_dev=a.n_dev, budget=a.budget, adaptive=not a.fixed_budget, extra=not a.base_features, negatives=a.negatives, head=a.head, rounds=a.rounds, depth=a.depth)
        print(json.dumps(s.metrics, sort_keys=True))
    elif a.job == "infer":
        print(json.dumps(jobs.infer(spark, a.data, a.models, a.output, scores=a.scores), sort_keys=True))
    elif a.job == "resolve":
        print(json.dumps(jobs.resolve(spark, a.matching, a.scores, a.output, a.winning_probability, a.conflict_margin), sort_keys=True))
    else:
        bad = [r for r in jobs.validate(spark, a.matching, a.candidate, a.data, check_ids=a.check_ids).collect() if r.n]  # a row a rule
        for r in bad:
            print(f"{r.rule}: {r.n} ({r.samples})")
        print("FAIL" if bad else "PASS")
        return int(bool(bad))
    return 0


if __name__ == "__main__":
    sys.exit(main())
