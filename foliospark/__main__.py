"""``python -m foliospark``: lists the queries; with a query and a folder of tables, runs it and shows or writes its rows."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from foliospark.plans import catalogue


def main() -> None:
    args = argparse.ArgumentParser(prog="foliospark", description=__doc__)
    args.add_argument("query", nargs="?", help="name of a query; none lists them")
    args.add_argument("tables", nargs="?", help="folder with the Parquet tables")
    args.add_argument("--out", help="folder to write the rows to, as Parquet")
    args.add_argument("--explain", action="store_true", help="show the physical plan instead")
    given = args.parse_args()
    known = catalogue.queries()
    if not given.query:
        print(*sorted(known), sep="\n")
        return
    if given.query not in known or not given.tables:
        args.error("give a known query and the folder of its tables")
    spark = SparkSession.builder.appName(f"foliospark {given.query}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    result = known[given.query](spark, given.tables)
    if given.explain:
        result.explain("formatted")
    elif given.out:
        result.write.mode("overwrite").parquet(given.out)
    else:
        result.show(50, truncate=80)
    spark.stop()


if __name__ == "__main__":
    main()
