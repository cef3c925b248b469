"""``python -m corvane [warehouse]``: one statement a line, ``exit`` to leave."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from corvane.errors import CorvaneError
from corvane.render import render
from corvane.session import Session


def main() -> None:
    spark = SparkSession.builder.appName("corvane").getOrCreate()
    session = Session(spark, sys.argv[1] if len(sys.argv) > 1 else "spark-warehouse/corvane")
    while True:
        try:
            line = input("db> ").strip()
        except EOFError:
            break
        if line == "exit":
            break
        if not line:
            continue
        start = time.perf_counter()
        try:
            print(render(session.sql(line)))
        except CorvaneError as e:
            print(e)
        print(f"{(time.perf_counter() - start) * 1e6:.0f} us")


if __name__ == "__main__":
    main()
