"""Headline queries, timed end to end from parquet; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.plans import registry  # noqa: E402
from riskloom.session import local_session, scratch  # noqa: E402

HEADLINE = [
    "flagship_risk_timeline", "e1_price_changes", "e2_volatility", "e3_moving_averages", "e4_rsi", "e5_macd", "e12_rolling_corr", "e21_tone_extremes", "e30_volatility_rank",
    "e36_volatility_regime", "b9_interpolate", "b10_winsorise", "c2_news_features", "c3_asof_filing", "c4_asof_nearest", "c8_full_by_key", "c11_interval_join", "c13_threshold_grid",
    "d1_daily_news", "d12_tone_scorecard", "e16_article_tone_volatility", "g1_clean_text", "g6_keywords", "g8_lexicon_tone", "g20_composite_risk", "h2_auc", "h8_event_analysis",
    "h15_score_stability", "h16_crisis_metrics", "h17_rolling_var", "h18_early_warning_score", "f3_dedupe_articles", "i11_regime_ensemble", "j2_permutation", "j7_ks", "k1_pair_correlation", "j13_garch", "k4_clustering", "l1_tone_monitor",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    registry.load()
    spark = local_session(cpus, cpus)
    warm = registry.QUERIES["e1_price_changes"](spark, d)
    warm.write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        if name not in registry.QUERIES:
            continue
        t0 = time.perf_counter()
        with scratch(spark):
            registry.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(d).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
