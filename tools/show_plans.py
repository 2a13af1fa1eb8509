"""Print the physical plans of the end-to-end job's stages (formatted
explain, reduced to operators, pushed filters, read schemas and exchanges).

    python tools/show_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from logtab import CP, HW, headers, parse, read_lines, rejects, stage, tabularize  # noqa: E402
from logtab.plans.fixtures import render_lines, table  # noqa: E402
from logtab.sources.lines import ORDER_COLS, in_order  # noqa: E402

KEEP = ("ReadSchema", "PushedFilters", "Exchange", "Sort", "HashAggregate", "BroadcastHashJoin",
        "CollectMetrics", "Generate", "Scan", "WholeStageCodegen", "Project [codegen")


def show(spark, title: str, df) -> None:
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    tree, details = text.split("\n\n", 1) if "\n\n" in text else (text, "")
    print(f"## {title}\n\n```")
    print(tree.strip())
    for line in details.splitlines():
        if any(k in line for k in KEEP):
            print(line[:200])
    print("```\n")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    tmp = tempfile.mkdtemp(prefix="logtab-plans-")
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "16").config("spark.checkpoint.dir", tmp)
             .config("spark.sql.codegen.hugeMethodLimit", "8000").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    render_lines(table(spark, sf_dir, "events")).select("value").coalesce(1).write.text(f"{tmp}/src")
    narrow = parse(read_lines(spark, f"{tmp}/src"))
    print("# Physical plans of the end-to-end job (`tools/show_plans.py`)\n")
    show(spark, "1. parse and stage (text scan → projections → Parquet)", narrow.drop("value"))
    staged = stage(narrow, f"{tmp}/staged")
    from logtab.operators.tabularize import distinct_keys
    show(spark, "2. key discovery (partial distinct; only parser + the staged key arrays read)",
         distinct_keys(staged))
    hdr = headers(staged)
    show(spark, "3a. wide hw table in source order (sorted while narrow, the fill above the exchange)",
         tabularize(in_order(staged.where(F.col("parser") == "hw").select(*ORDER_COLS, "parser", "hw")), HW, hdr["hw"]))
    show(spark, "3b. wide cp table, unordered (no shuffle at all)", tabularize(staged, CP, hdr["cp"]))
    show(spark, "4. rejects in source order", in_order(rejects(staged, keep=ORDER_COLS)))
    show(spark, "5. filter on parser over an unstaged parse (stays above the parse)",
         narrow.where(F.col("parser") == "cp").select("cp.*"))


if __name__ == "__main__":
    main()
