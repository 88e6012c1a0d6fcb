"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
local cores, BENCH_QUERIES a comma-separated choice of queries. Every query runs
to completion over its whole result (written to the ``noop`` sink), after a run on
the smallest tables beside them (BENCH_WARM_DIR, empty for none) that is not timed.

The given tables are files of one row group, which one core reads. So the tables that
the queries use are first written in many files, in a folder that goes with the run; that is
not timed. BENCH_TIMES (default 1) writes so many copies of the rows, with ids of their own.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "squad_eval_by_lang best_over_golds token_f1 normalize_answer "
    "row_index dedup_runs concat_contexts rebase_answer_start join_group_context "
    "pack_blocks shuffle_seeded make_batches "
    "align_answer encode_pair span_policy filter_valid_spans prepare_long_features "
    "tokenize_offsets build_vocab ids_tokens wrap_special mlm_mask "
    "extract_span distributed_eval alias_accuracy wrong_answers "
    "length_profile concat_fit row_audit bits_per_token binary_metrics align_predictions "
    "label_long_spans trivia_training_batches evaluate_model_report"
).split()


#: The tables that the queries read, and the ids that tell copies of their rows apart.
TABLES = {"documents": ["doc_id"], "labels": ["doc_id"], "conversations": ["conv_id"], "embeddings": ["vec_id"]}


def spread(spark, sf_dir: str, folder: str, times: int, files: int) -> str:
    """The tables in many files, and so many copies of their rows."""
    from pyspark.sql import functions as F

    target = f"{folder}/{Path(sf_dir).name}"
    for name, ids in TABLES.items():
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if times > 1:
            top = rows.agg(*[F.max(c).alias(c) for c in ids]).first()
            rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
            rows = rows.withColumns({c: F.col(c) + F.col("_copy") * (top[c] + 1) for c in ids}).drop("_copy")
        # neighbours stay together, as in files that are written in turn
        rows.repartitionByRange(files, *ids).sortWithinPartitions(*ids).write.parquet(f"{target}/{name}.parquet")
    return target


def main() -> None:
    from pyspark.sql import SparkSession

    from checks.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    scratch = tempfile.TemporaryDirectory(prefix="spanloom-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("spanloom-bench")
        .config("spark.checkpoint.dir", f"{scratch.name}/shared")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.environ.get("BENCH_WARM_DIR", str(Path(sf_dir).parent / "sf0.001"))
    name_of = Path(sf_dir).name.removeprefix("sf")
    sf_dir = spread(spark, sf_dir, scratch.name, int(os.environ.get("BENCH_TIMES", "1")), 4 * int(cpus if cpus.isdigit() else 8))
    times = {}
    for name in names:
        if warm and Path(warm).is_dir():
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": name_of,
            }
        )
    )


if __name__ == "__main__":
    main()
