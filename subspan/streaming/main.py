"""The worker as a program: settings from the environment, requests from one folder, results to another."""

from __future__ import annotations

import sys
from collections.abc import Mapping

from pyspark.sql import SparkSession

from subspan.config import WorkerConfig
from subspan.streaming.jobs import request_stream, run_worker


def main(args: list[str], env: Mapping[str, str] | None = None, spark: SparkSession | None = None) -> int:
    """Work off all requests in the folder args[0] into args[1]. 0 if the stream ended well, 1 for bad settings or a failed stream, 2 for bad arguments."""
    if len(args) != 2:
        print("usage: python -m subspan.streaming.main REQUESTS RESULTS", file=sys.stderr)
        return 2
    try:
        config = WorkerConfig.load(env)
        spark = spark or SparkSession.builder.appName(config.worker_id).getOrCreate()
        run_worker(request_stream(spark, args[0]), args[1], config.worker_id).awaitTermination()
    except Exception as e:  # noqa: BLE001  a program tells of its failure by its exit code
        print(f"worker failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
