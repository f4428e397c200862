"""Command line: spark-submit feedworks/jobs.py <job> --root DIR [options]"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from pathlib import Path

if __package__ is None:  # run as a script
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession

from feedworks.plans import segments
from feedworks.plans.ddl import create_tables
from feedworks.plans.ingest import ingest_members, ingest_redemptions
from feedworks.plans.layout import Layout
from feedworks.plans.profile import create_profile_view, member_redemption_profile
from feedworks.plans.reports import quality_reports
from feedworks.plans.smoke import storage_check
from feedworks.session import tune
from feedworks.streaming.available_now import stream_members, stream_redemptions


def _members(spark, args, layout):
    print(
        ingest_members(
            spark, args.incoming, layout, args.as_of, args.now, args.check_whole,
            register=True,
        )
        or "nothing new"
    )


def _redemptions(spark, args, layout):
    print(
        ingest_redemptions(
            spark, args.incoming, layout, args.as_of, args.now, args.check_whole
        )
        or "nothing new"
    )


def _stream_members(spark, args, layout):
    stream_members(
        spark, args.incoming, layout, args.checkpoint, args.as_of, args.now,
        check_whole=args.check_whole,
    ).awaitTermination()


def _stream_redemptions(spark, args, layout):
    stream_redemptions(
        spark, args.incoming, layout, args.checkpoint, args.as_of, args.now,
        check_whole=args.check_whole,
    ).awaitTermination()


def _exports(spark, args, layout):
    members = layout.member_target.read(spark)
    segments.write_country_tables(members, layout.segments)
    segments.register_country_tables(spark, layout.segments)
    for name in segments.write_country_files(members, layout.exports):
        print(f"no file layout for {name}: skipped")


def _reports(spark, args, layout):
    for name, report in quality_reports(spark, layout).items():
        print(name)
        report.show(truncate=False)


def _profile(spark, args, layout):
    member_redemption_profile(
        layout.redemption_target.read(spark), layout.member_target.read(spark)
    ).limit(20).show(truncate=False)


def _tables(spark, args, layout):
    create_tables(spark, layout)
    create_profile_view(spark)


def _compact(spark, args, layout):
    for target in (layout.member_target, layout.redemption_target):
        if target.exists(spark):
            print(f"{target.name}: {target.compact(spark, SMALL_FILE)} files rewritten")


def _smoke(spark, args, layout):
    storage_check(spark, f"{layout.root}/smoke").show(truncate=False)


# Files below a quarter of a usual block are written together.
SMALL_FILE = 32 << 20

JOBS = {
    "members": _members,
    "redemptions": _redemptions,
    "stream-members": _stream_members,
    "stream-redemptions": _stream_redemptions,
    "exports": _exports,
    "reports": _reports,
    "profile": _profile,
    "tables": _tables,
    "compact": _compact,
    "smoke": _smoke,
}


# Options without which a job cannot begin.
NEEDED = {
    "incoming": {"members", "redemptions", "stream-members", "stream-redemptions"},
    "checkpoint": {"stream-members", "stream-redemptions"},
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="feedworks")
    parser.add_argument("job", choices=JOBS)
    parser.add_argument("--root", required=True, help="folder of all tables")
    parser.add_argument("--incoming", help="folder of new files")
    parser.add_argument("--checkpoint", help="folder of the stream's progress")
    parser.add_argument(
        "--as-of", type=dt.date.fromisoformat, default=dt.date.today()
    )
    parser.add_argument(
        "--skip-whole-check",
        dest="check_whole",
        action="store_false",
        help="check key uniqueness of changed rows only",
    )
    args = parser.parse_args(argv)
    for option, jobs in NEEDED.items():
        if args.job in jobs and not getattr(args, option):
            parser.error(f"{args.job} needs --{option}")
    args.now = dt.datetime.now(dt.timezone.utc)
    spark = tune(SparkSession.builder.appName(f"feedworks-{args.job}").getOrCreate())
    JOBS[args.job](spark, args, Layout(args.root))


if __name__ == "__main__":
    main()
