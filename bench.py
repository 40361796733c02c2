"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one warm-up, median of three runs."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rowscrub.functions import text as X  # noqa: E402
from rowscrub.operators import columns as C  # noqa: E402
from rowscrub.operators import profile as A  # noqa: E402
from rowscrub.operators import repair as S  # noqa: E402
from rowscrub.operators import rows as R  # noqa: E402
from rowscrub.plans import catalogue as Q  # noqa: E402
from rowscrub.plans import workflow as W  # noqa: E402
from rowscrub.session import local_session, scratch_path  # noqa: E402
from rowscrub.sources import sinks  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def clean(spark):
    consume(C.clean_strings(Q.table(spark, FOLDER, "documents").select("doc_id", "text")))


def keep_only(spark):
    docs = Q.table(spark, FOLDER, "documents").select("doc_id", "text")
    consume(C.map_columns(docs, ["text"], lambda c: X.keep_patterns(c, Q.KEPT)))


def profile(spark):
    consume(A.pattern_profile(Q.table(spark, FOLDER, "documents"), uncovered=True))


def dedup_all(spark):
    consume(R.dedup(Q.table(spark, FOLDER, "lineitem")))


def dedup_key(spark):
    consume(R.dedup(Q.table(spark, FOLDER, "lineitem"), ["l_partkey", "l_suppkey"]))


def dedup_ordered(spark):
    consume(R.dedup(Q.table(spark, FOLDER, "lineitem"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]))


def nest_and_write(spark):
    sinks.write_parquet(Q.nested_customers(spark, FOLDER), scratch_path(spark, "bench-nested"))


def workflow(spark):
    sinks.write_parquet(W.cli_workflow(Q.workflow_input(spark, FOLDER), Q.WORKFLOW), scratch_path(spark, "bench-workflow"))


def self_configured(spark):
    consume(Q.workflow_default_rules(spark, FOLDER))


def repair(spark):
    consume(S.check_records(Q.csv_lines(spark, FOLDER), Q.EVENT_FIELDS))


def repair_numbered(spark):
    consume(Q.csv_bad_row_numbers(spark, FOLDER))


def repair_quoted(spark):
    consume(Q.csv_quoted_fields(spark, FOLDER))


def repair_multi_line(spark):
    consume(Q.csv_multi_line(spark, FOLDER))


BENCHES = [clean, keep_only, profile, dedup_all, dedup_key, dedup_ordered, nest_and_write, workflow, self_configured,
           repair, repair_numbered, repair_quoted, repair_multi_line]


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:]
    seconds = {}
    for bench in BENCHES:
        if wanted and bench.__name__ not in wanted:
            continue
        bench(spark)
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            bench(spark)
            runs.append(time.perf_counter() - start)
        seconds[bench.__name__] = round(statistics.median(runs), 3)
    rows = {t: spark.read.parquet(f"{FOLDER}/{t}.parquet").count() for t in ("documents", "lineitem", "events", "customer")}
    print(
        json.dumps(
            {"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
             "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "cpus": CPUS, "rows": rows}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
