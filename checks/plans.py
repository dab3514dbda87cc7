"""Print the physical plans of the headline queries and write PLANS.md: for each query,
the operator tree plus the lines that show what the plan does at scale (scan pruning,
pushed filters, partial top-k, partial aggregation, dynamic partition pruning,
broadcasts, shuffles)."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HEADLINE = ["semantic_search", "keyword_search", "routed_search", "dedup_last", "book_info", "embed_corpus",
            "parallel_chapter", "scope_resolve"]
KEYS = re.compile(r"(ReadSchema|PushedFilters|PartitionFilters|dynamicpruning|WindowGroupLimit|"
                  r"HashAggregate|ObjectHashAggregate|SortAggregate|BroadcastExchange|Exchange|MapInArrow|MapInPandas|"
                  r"BroadcastHashJoin|BroadcastNestedLoopJoin|SortMergeJoin|Scan parquet)")


def main(sf_dir: str = "/root/testdata/sf0.01", out: str = "PLANS.md") -> None:
    from lectio.catalog import QUERIES
    from lectio.session import local_session
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    parts = ["# Physical plans of the headline queries\n",
             f"Generated by `python checks/plans.py` on `{sf_dir}` (final adaptive plans after one run).\n"]
    for name in HEADLINE:
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        text = df._jdf.queryExecution().executedPlan().toString()
        formatted = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        tree = formatted.split("\n\n")[0]
        keys = sorted({ln.strip() for ln in formatted.splitlines() if KEYS.search(ln) and ":" in ln and
                       not ln.strip().startswith(("+-", ":"))})
        parts.append(f"## {name}\n\n```\n{tree.strip()}\n```\n\nKey lines:\n\n```\n" + "\n".join(keys[:40]) + "\n```\n")
        del text
    with open(out, "w", encoding="utf-8") as f:
        f.write("\n".join(parts))
    print(f"wrote {out}")


if __name__ == "__main__":
    main(*sys.argv[1:])
