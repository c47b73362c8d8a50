"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Every query is fully materialised with the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from rtq.session import get_session
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * int(cpus)))

    from rtq.plans.pipeline import feature_table
    from rtq.plans.registry import QUERIES, load_all
    load_all()

    def sink(df):
        df.write.format("noop").mode("overwrite").save()

    headline = {
        # Entry 1: segments -> alignment -> classes -> sense paths -> six features.
        "features_tok_conv": lambda: feature_table(spark, sf_dir),
        # The chain after alignment, SQL-verified (AGG9 over equal-position pairs).
        "features_same_position": lambda: QUERIES["AGG9_segment_features"](spark, sf_dir),
        # Sense distance over the distinct lemma pairs (PATH1-7).
        "sense_distance": lambda: QUERIES["PATH7_sense_distance"](spark, sf_dir),
        # Alignment alone (ALN5, TOK).
        "word_alignment_tok": lambda: QUERIES["ALN5_word_alignment_tok"](spark, sf_dir),
        # Near-identical matches and cleaning (ALN0).
        "match_same_tokens": lambda: QUERIES["ALN0_match_same_tokens"](spark, sf_dir),
        # Lexicon join heavy query (2.2M rows at sf0.01).
        "word_sense_join": lambda: QUERIES["JN2_word_sense_join"](spark, sf_dir),
        # Entry 3 tail: clamp, min-max, system means, Pearson.
        "system_pearson": lambda: QUERIES["AGG12_pearson"](spark, sf_dir),
    }
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    times = {}
    for name, build in headline.items():
        if only and name not in only:
            continue
        t0 = time.time()
        sink(build())
        times[name] = round(time.time() - t0, 2)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 2), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
