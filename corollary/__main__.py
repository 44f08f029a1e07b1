"""A shell on a knowledge base: ``python -m corollary [script ...]``. Scripts are run first, then lines of the standard input."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .kb import KB


def shown(row: dict) -> str:
    """A report row as text; a find's bindings one to a line."""
    if row["kind"] == "find":
        return "\n".join(", ".join(f"{k} = {v}" for k, v in r.items()) for r in row["result"]) or "nothing"
    if isinstance(row["result"], list) and row["kind"] != "tell":
        return "\n".join(map(str, row["result"])) or "nothing"
    return f"{row['kind']}: {row['result']}"


def main(scripts: list[str], lines) -> None:
    spark = SparkSession.builder.appName("corollary").getOrCreate()
    kb = KB(spark)
    for path in scripts:
        for row in kb.run_file(path):
            print(shown(row))
    for line in lines:
        if line.strip() == ":quit":
            break
        for row in kb.run_script(line):
            print(shown(row), flush=True)


if __name__ == "__main__":
    main(sys.argv[1:], sys.stdin)
