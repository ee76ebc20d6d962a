"""python -m shelfmark create|list|extract|verify|preview …"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from shelfmark.plans import archive as V


def main(argv: list[str] | None = None) -> int:
    """0 done, 1 failed, 3 conflicts."""
    parser = argparse.ArgumentParser(prog="shelfmark")
    verbs = parser.add_subparsers(dest="verb", required=True)
    create = verbs.add_parser("create")
    create.add_argument("archive")
    create.add_argument("roots", nargs="+")
    create.add_argument("--exclude", action="append", default=[])
    create.add_argument("--preset", action="append", default=[], choices=("system", "daw_cache"))
    create.add_argument("--level", type=int, default=6)
    for verb in ("list", "verify", "preview"):
        verbs.add_parser(verb).add_argument("archive")
    extract = verbs.add_parser("extract")
    extract.add_argument("archive")
    extract.add_argument("folder")
    extract.add_argument("--overwrite", default="skip", choices=("skip", "replace", "undecided"))
    parser.add_argument("--json", action="store_true")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("shelfmark").getOrCreate()

    def show(rows: list[dict], text: str) -> None:
        print(json.dumps(rows) if a.json else text)

    if a.verb == "create":
        plan = V.Plan.of(V.scan_folders(spark, a.roots, a.exclude, tuple(a.preset)))
        found = [r.asDict() for r in plan.conflicts().orderBy("first_entry").toLocalIterator()]
        if found:
            show(found, "\n".join(f"{c['kind']}: {c['collision_key']}" for c in found))
            return 3
        n = plan.build(a.archive, a.level)
        show([{"entries": n}], f"{n} entries")
        return 0
    archive = V.Archive(spark, a.archive)
    if a.verb == "list":
        for r in archive.listing().orderBy("entry").toLocalIterator():
            show([r.asDict()], r["line"])
        return 0
    if a.verb == "preview":
        print(archive.preview_json())
        return 0
    failed = 0
    results = archive.verify() if a.verb == "verify" else archive.extract(a.folder, a.overwrite)
    for r in results.toLocalIterator():
        failed += r["status"] not in ("ok", "skipped")
        show([r.asDict()], f"{r['status']:20} {r['target'] if a.verb == 'extract' else r['entry']}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
