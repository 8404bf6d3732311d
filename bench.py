"""Headline timings: one JSON line. Each query runs to completion into a no-op sink.

Inputs and shared results are staged first and timed on their own (``stage_*``), then the queries read them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

STAGES = ("bars", "edges", "technicals", "as_of_rows", "observations", "analyses", "deals", "assessed", "outcomes", "portfolios")
HEADLINES = (
    "market_factor", "decompositions", "screen_by_score", "horizon_metrics", "cause_metrics", "regime_by_cause",
    "feature_ic", "ic_by_year", "score_buckets", "evidence_signals", "evidence_scores", "deal_verdicts",
    "research_tasks", "deal_hurdles", "tilted_outcomes", "tail_sensitivity", "portfolio_odds", "order_value_quantiles",
    "payload_quarantine", "filing_listings", "positions_current", "stream_session_bars",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from checks.compare import local_session
    from ebbline import fixtures
    from ebbline.config import WalkForwardConfig
    from ebbline.plans import walkforward
    from ebbline.queries import QUERIES, inputs
    from ebbline.staging import staged

    spark = local_session(cpus)
    seconds: dict[str, float] = {}

    def timed(name, fn):
        t = time.time()
        fn()
        seconds[name] = round(time.time() - t, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    i = inputs(spark, sf_dir)
    for s in STAGES:
        timed(f"stage_{s}", lambda s=s: getattr(i, s))
    for q in HEADLINES:
        timed(q, lambda q=q: drain(QUERIES[q](spark, sf_dir)))

    days = staged(fixtures.capped_bars(spark, sf_dir, unit="day"))
    timed("walk_forward_daily", lambda: drain(walkforward.observations(days, i.edges, WalkForwardConfig())))
    print(
        json.dumps(
            {"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}
        )
    )


if __name__ == "__main__":
    main()
