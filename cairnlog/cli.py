"""python -m cairnlog.cli extract_template --file LOG --store STORE.json --output SEQUENCE.json [--format LAYOUT]"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairnlog.functions import masking
from cairnlog.functions.families import FAMILIES
from cairnlog.operators import drain, profiles
from cairnlog.sources import stores
from cairnlog.sources.lines import read_lines


def extract_template(spark: SparkSession, log: str, store: str, output: str, layout: str = "{time} {log}") -> dict:
    """Mines a file, continues the template store, writes the sequence of template ids; gives a summary."""
    before = stores.load_templates(store)
    lines = read_lines(spark, log).select("line_no", "text")
    read = profiles.match_lines(lines, layout, profiles.Recognizer(FAMILIES), ["line_no"])
    message = F.coalesce(F.expr("fields['log'].value"), F.col("text"))
    content = masking.masked(lines.join(read.select("line_no", "fields"), "line_no").select("line_no", message.alias("content")), "content")
    numbered, templates = drain.mine(content, stored=before)
    counts = {i: [t, c] for i, t, c in before}
    for r in templates.collect():
        old = counts.get(r.template_id, [None, 0])
        counts[r.template_id] = [r.pattern.split(" "), old[1] + r.n]
    stores.save_templates(store, [(i, t, c) for i, (t, c) in counts.items()])
    ids = [r.template_id for r in numbered.orderBy("line_no").toLocalIterator(prefetchPartitions=True)]  # the file to write holds one id a line; rows come partition by partition
    stores.write_atomically(output, {"schema_version": 1, "source_file": log, "format": layout, "line_count": len(ids), "template_ids": ids})
    return {"lines": len(ids), "templates": len(counts), "new_templates": len(counts) - len(before)}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cairnlog")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract_template")
    for name in ("file", "store", "output"):
        e.add_argument(f"--{name}", required=True)
    e.add_argument("--format", default="{time} {log}")
    a = p.parse_args(argv)
    try:
        spark = SparkSession.builder.appName("cairnlog").getOrCreate()
        print(json.dumps(extract_template(spark, a.file, a.store, a.output, a.format)))
        return 0
    except Exception as error:  # noqa: BLE001
        print(json.dumps({"error": str(error).split("\n")[0]}), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
