"""What the jobs share: command line, config file, session, log."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
log = logging.getLogger("jobs")


#: For Python workers: memory that is freed goes back to the system, so that idle ones hold little.
WORKER = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20)}


def ship(spark: SparkSession) -> None:
    """Let Python workers that share this file tree import the library (elsewhere it is installed or given with --py-files), and give memory back."""
    env = spark.sparkContext.environment
    for key, value in WORKER.items():
        env.setdefault(key, value)
    parts = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if str(ROOT) not in parts:
        env["PYTHONPATH"] = ":".join([str(ROOT), *parts])


def exactly(path: str) -> str:
    """A glob of just this path: a file stream takes a single file only so."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def main(name: str, run: Callable, config: str, argv: list[str] | None = None) -> None:
    """Read the config, let the command line override its entries, and run in a session that is stopped at the end."""
    ap = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    ap.add_argument("--config", default=str(ROOT / "jobs" / "conf" / config))
    known, rest = ap.parse_known_args(argv)
    values = json.loads(Path(known.config).read_text())
    more = argparse.ArgumentParser(parents=[ap], add_help=False, conflict_handler="resolve")
    for key, value in values.items():
        more.add_argument(f"--{key}", default=value, type=type(value) if isinstance(value, (int, float, str)) else json.loads)
    given = vars(more.parse_args(rest))
    given.pop("config", None)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    os.environ.setdefault("PYTHONPATH", str(ROOT))
    spark = SparkSession.builder.appName(f"strandlake {name}").getOrCreate()
    try:
        run(spark, **given)
    finally:
        spark.stop()
