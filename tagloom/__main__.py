"""Command line: ``python -m tagloom QUERY --data FOLDER [--out FOLDER] [--format parquet|json|csv|markdown|ascii] [--limit N]``, or ``--list``.

``--options FILE`` reads a bundle of the same options from JSON or YAML; what is given on the line wins.
"""

from __future__ import annotations

import argparse

from tagloom.operators import reports
from tagloom.plans.staging import drop_staged, local_session
from tagloom.queries import QUERIES
from tagloom.sources import readers

FORMATS = ("parquet", "json", "csv", "markdown", "ascii")


def main(argv: list[str] | None = None, queries: dict | None = None) -> int:
    queries = QUERIES if queries is None else queries
    p = argparse.ArgumentParser(prog="tagloom", description="Runs one registered query.")
    p.add_argument("query", nargs="?", metavar="QUERY")
    p.add_argument("--data", help="folder of the Parquet tables")
    p.add_argument("--out", help="folder to write; without it the first rows are shown")
    p.add_argument("--format", choices=FORMATS, help="of what is written or shown; markdown and ascii are for reports of a few rows and are always shown")
    p.add_argument("--limit", type=int, help="rows to show")
    p.add_argument("--options", help="JSON or YAML file with these options")
    p.add_argument("--list", action="store_true", help="names of all queries")
    a = p.parse_args(argv)
    given = {"data": ".", "format": "parquet", "limit": 20} | (readers.read_config(a.options) if a.options else {}) | {k: v for k, v in vars(a).items() if v is not None}
    name = given.get("query")
    if a.list or not name:
        print("\n".join(sorted(queries)))
        return 0
    if name not in queries:
        p.error(f"no such query: {name}")
    spark = local_session()
    df = queries[name](spark, given["data"])
    if given["format"] in ("markdown", "ascii"):
        print("\n".join((reports.markdown_table if given["format"] == "markdown" else reports.ascii_table)(df)))
    elif given.get("out"):
        df.write.mode("errorifexists").format(given["format"]).save(given["out"])
    else:
        df.show(int(given["limit"]), truncate=80)
    drop_staged(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
