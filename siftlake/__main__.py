"""Queries over a stored key-value table: `python -m siftlake PATH COMMAND ...`. Each change appends to the operation log in PATH/log."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import functions as F

from .config import DedupConfig
from .errors import NotFound
from .operators import retention, store
from .session import build_session

SCHEMA = "seq bigint, ts timestamp, key string, value string"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siftlake")
    p.add_argument("path")
    p.add_argument("--ttl", type=int, default=0, help="seconds; 0: for ever")
    c = p.add_subparsers(dest="command", required=True)
    for name, args in {"put": ["key", "value"], "get": ["key"], "del": ["key"], "count": [], "count-approx": [], "keys": ["--prefix", "--limit"], "sweep": [], "prune": ["--max-age", "--max-idle"], "evict": ["target"], "health": []}.items():
        sub = c.add_parser(name)
        for a in args:
            sub.add_argument(a, **({} if a[0] != "-" else {"default": "" if a == "--prefix" else 0, "type": str if a == "--prefix" else int}))
    a = p.parse_args(argv)
    spark = build_session()
    now = datetime.datetime.now(datetime.timezone.utc)
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(f"{a.path}/log")
    s = store.Store(spark.read.schema(SCHEMA).parquet(f"{a.path}/log"), DedupConfig(default_ttl_seconds=a.ttl))
    at = F.lit(now)
    if a.command in ("put", "del"):
        row = [(int(now.timestamp() * 1_000_000), now, a.key, a.value if a.command == "put" else None)]
        spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("append").parquet(f"{a.path}/log")
    elif a.command == "get":
        try:
            print(s.get(a.key, at))
        except NotFound:
            return 1
    elif a.command == "count":
        print(s.refs.count())
    elif a.command == "count-approx":
        store.approximate_counts(s.refs, "key", "object_id").show()
    elif a.command == "keys":
        for r in store.list_keys(s.refs, a.prefix, a.limit).toLocalIterator():
            print(r.key)
    elif a.command == "health":
        s.health(at).show(truncate=False)
    else:
        gone = {"sweep": lambda: retention.sweep(s.objects, at, a.ttl), "prune": lambda: retention.prune(s.objects, at, a.max_age, a.max_idle), "evict": lambda: retention.evict_lru(s.objects, int(a.target))}[a.command]()
        keys = s.refs.join(gone.select("object_id"), "object_id", "left_semi").select("key")
        # an object goes with its references: their keys are deleted in the log
        rows = keys.select(F.lit(int(now.timestamp() * 1_000_000)).alias("seq"), at.alias("ts"), "key", F.lit(None).cast("string").alias("value"))
        n = gone.count()
        rows.write.mode("append").parquet(f"{a.path}/log")
        print(n)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
