"""Command line: build, update, search, or build and search at once as `run`, which is also meant where a folder and a query frame come first."""

from __future__ import annotations

import argparse
import sys
import time

from .config import Config, Geometry
from .plans.build import build, update
from .plans.find import candidate_report, find, histogram_report
from .session import session
from .sinks.ppm import dump_winner


COMMANDS = ("build", "update", "search", "run")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="framequarry", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("frames", help="folder of videos (build, update, run) or database (search)")
    p.add_argument("query", nargs="?", help="raw query frame (search, run)")
    p.add_argument("--database", default="newDB", help="where a build writes")
    p.add_argument("--output", default="winner.ppm")
    p.add_argument("--topk", type=int, default=50)
    p.add_argument("--dedup-threshold", type=int, default=8000)
    p.add_argument("--chunk-frames", type=int, default=1200)
    p.add_argument("--width", type=int, default=1280)
    p.add_argument("--height", type=int, default=720)
    p.add_argument("--index-edge", choices=["truncate", "absorb"], default="truncate", help="what the cells do with pixels beyond a multiple of 8")
    p.add_argument("--grey", action="store_true", help="frames of one channel; no pixmap is written")
    p.add_argument("--reset-on-video", action="store_true", help="keep the first frame of every video")
    p.add_argument("--gpu", type=int, default=0, help="accepted and ignored")
    p.add_argument("--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """0 done or usage shown, 1 the work failed, 2 a bad argument."""
    argv = sys.argv[1:] if argv is None else argv
    if len(argv) < 2:
        parser().print_help()
        return 0
    if argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv = ["run", *argv]
    args = parser().parse_args(argv)
    if args.command in ("search", "run") and args.query is None:
        parser().error("a query frame is needed")
    try:
        cfg = Config(Geometry(args.width, args.height, 1 if args.grey else 3), args.chunk_frames, args.dedup_threshold, args.topk, reset_on_video=args.reset_on_video, index_edge=args.index_edge)
    except ValueError as e:
        parser().error(str(e))
    began = time.perf_counter()
    database = args.frames if args.command == "search" else args.database
    try:
        spark = spark or session()
        if args.command != "search":
            s = (update if args.command == "update" else build)(spark, args.frames, database, cfg)
            print(f"frames {s.frames_total}, kept {s.frames_after_dedup}, signatures {s.signatures_written}")
            if args.verbose:
                from .operators.stats import chunk_stats
                from .sources.database import features

                chunk_stats(features(spark, database)).orderBy("chunk_id").show(1000, False)
        if args.command in ("search", "run"):
            if args.verbose:
                histogram_report(spark, database, args.query, cfg).orderBy("dist").show(65)
                candidate_report(spark, database, args.query, cfg).show(cfg.topk)
            r = find(spark, database, args.query, cfg)
            print(f"idx={r.best_db_index} video_id={r.video_id} frame_id={r.frame_id} dist={r.dist} sad={r.sad}" if r.found else "nothing found")
            if not args.grey and dump_winner(spark, database, cfg.geometry, r, args.output):
                print(f"Saved {args.output}")
        print(f"total {time.perf_counter() - began:.1f} s")
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
