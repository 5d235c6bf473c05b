"""``python -m rowdex.cli kill|benchmark``."""

from __future__ import annotations

import argparse
import json
import os
import statistics
import sys
import time
from collections.abc import Callable, Sequence
from itertools import islice

from rowdex.api import default_dir, load_dataset
from rowdex.operators.lifecycle import stop_all_background_tasks


def remove_stale(folder: str) -> int:
    """Removes unfinished files below a folder; how many."""
    gone = 0
    for place, _, names in os.walk(folder):
        for name in names:
            if ".tmp" in name or ".part." in name:
                os.remove(os.path.join(place, name))
                gone += 1
    return gone


def measure(call: Callable, runs: int, warmup: int) -> dict:
    """Milliseconds of ``runs`` calls after ``warmup`` more."""
    times = []
    for k in range(warmup + runs):
        began = time.perf_counter()
        call()
        if k >= warmup:
            times.append(1e3 * (time.perf_counter() - began))
    return {"mean_ms": statistics.mean(times), "min_ms": min(times), "max_ms": max(times), "stdev_ms": statistics.stdev(times) if len(times) > 1 else 0.0}


def run_benchmark(path: str, split: str | None, target: int, columns: list[str] | None, runs: int, warmup: int, loader: bool) -> dict:
    began = time.perf_counter()
    view = load_dataset(path, split=split or "train", columns=columns, manage=False)
    out = {"init_ms": 1e3 * (time.perf_counter() - began), "rows": len(view)}
    at = target if target < len(view) else len(view) // 2
    out["first_row"] = measure(lambda: view[0], runs, warmup)
    out["seek"] = measure(lambda: view[at], runs, warmup)
    out["next_row"] = measure(lambda: view[min(at + 1, len(view) - 1)], runs, warmup)
    out["slice"] = measure(lambda: view[at : at + 6], runs, warmup)
    out["stream"] = measure(lambda: list(islice(view.iter_from(at), 3)), runs, warmup)
    if loader:
        out["loader"] = view.to_dataloader(batch_size=32).benchmark(max(10, 10 * runs), 1).to_dict()
    return out


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rowdex")
    commands = parser.add_subparsers(dest="command", required=True)
    kill = commands.add_parser("kill", help="stop background work and remove unfinished files")
    kill.add_argument("--cache-dir", default=default_dir("cache"))
    bench = commands.add_parser("benchmark", help="time access by position")
    bench.add_argument("path")
    bench.add_argument("--split")
    bench.add_argument("--target-index", type=int, default=50_000)
    bench.add_argument("--columns", nargs="*")
    bench.add_argument("--runs", type=int, default=3)
    bench.add_argument("--warmup", type=int, default=1)
    bench.add_argument("--loader", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "kill":
        print(json.dumps({"stopped": stop_all_background_tasks(), "removed": remove_stale(args.cache_dir)}))
    else:
        print(json.dumps(run_benchmark(args.path, args.split, args.target_index, args.columns, args.runs, args.warmup, args.loader)))
    return 0


def kill(argv: Sequence[str] | None = None) -> int:
    return main(["kill", *(sys.argv[1:] if argv is None else argv)])


def benchmark(argv: Sequence[str] | None = None) -> int:
    return main(["benchmark", *(sys.argv[1:] if argv is None else argv)])


if __name__ == "__main__":
    sys.exit(main())
