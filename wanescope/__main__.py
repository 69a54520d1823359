"""python -m wanescope scores.csv [--top-k 0.2] [--n-boot 1000] [--date-col d] [--score-col s] [--json]"""

from __future__ import annotations

import argparse
import json

from wanescope.plans.halflife import report
from wanescope.session import build_session
from wanescope.sources.files import read_scores_csv


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="wanescope", description="How fast does a benchmark stop separating models?")
    p.add_argument("scores")
    p.add_argument("--benchmark", default="scores")
    p.add_argument("--top-k", type=float, default=0.2)
    p.add_argument("--n-boot", type=int, default=1000)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--date-col")
    p.add_argument("--score-col")
    p.add_argument("--json", action="store_true")
    a = p.parse_args(argv)
    spark = build_session()
    rows = [r.asDict() for r in report(read_scores_csv(spark, a.scores, a.benchmark, a.date_col, a.score_col), a.top_k, a.n_boot, a.seed).collect()]
    if a.json:
        print(json.dumps(rows, indent=2))
    else:
        for r in rows:
            half = "not measurable" if r["halflife"] is None else f"{r['halflife']:.2f} months"
            span = "" if r.get("lo") is None else f" [{r['lo']:.2f}, {r['hi']:.2f}]"
            print(f"{r['benchmark']}: {half}{span}, {r['status']}; {r['n_models']} models, {r['n_quarters']} quarters")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
