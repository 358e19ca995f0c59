"""Bench: headline operators at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The inputs (raw dialogues, parsed corpus, predictions, pair inputs) are rendered
and written once before the clock starts, for all operators alike; each operator
then reads files and runs to completion into Spark's ``noop`` sink. ``rows_s``
is input rows per second. The value is the sum of the wall times.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from toolcorpus.functions.calls import parse_call  # noqa: E402
from toolcorpus.operators import pairs as E  # noqa: E402
from toolcorpus.operators import parse as B  # noqa: E402
from toolcorpus.operators import prompts as PR  # noqa: E402
from toolcorpus.operators import reports as R  # noqa: E402
from toolcorpus.operators import scoring as S  # noqa: E402
from toolcorpus.plans.stages import materialize  # noqa: E402
from toolcorpus.session import build_session  # noqa: E402
from toolcorpus.sources import fixtures as FX  # noqa: E402

# name: (input, operator)
HEADLINE = {
    "parse_corpus": ("dialogues", lambda d: B.parse_corpus(d, calls_only=True)),
    "split_exact": ("corpus", lambda d: B.split_corpus(d, 0.05, 42, "exact").select("example_id", "split")),
    "sft_text": ("corpus", lambda d: PR.sft_text(d).select("example_id", "text")),
    "pair_examples": ("corpus", E.pair_examples),
    "build_pairs": ("pairs", E.build_pairs),
    "parse_calls": ("predictions", lambda d: d.select("model", "example_id", parse_call(F.col("prediction"), "metrics").alias("call"))),
    "score_examples": ("predictions", S.score_examples),
    "metrics_report": ("predictions", lambda d: S.metrics_report(S.score_examples(d))),
    "comparison_table": ("predictions", lambda d: R.comparison_table(S.metrics_report(S.score_examples(d)))),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session()

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    inputs = {"dialogues": materialize(FX.raw_dialogues(spark, sf_dir), "bench-dialogues"),
              "predictions": materialize(FX.eval_rows(spark, sf_dir), "bench-predictions"),
              "pairs": materialize(FX.pair_input(spark, sf_dir), "bench-pairs")}
    inputs["corpus"] = materialize(B.parse_corpus(inputs["dialogues"]), "bench-corpus")
    rows = {k: d.count() for k, d in inputs.items()}
    run(S.score_examples(inputs["predictions"].limit(1000)))  # starts the Python workers
    times = {}
    for name, (source, op) in HEADLINE.items():
        t0 = time.perf_counter()
        run(op(inputs[source]))
        times[name] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "rows_s": {n: round(rows[HEADLINE[n][0]] / t) for n, t in times.items()}, "sf": sf}))


if __name__ == "__main__":
    main()
