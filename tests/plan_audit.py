"""Audit the physical plans of the catalog queries.

Usage: python tests/plan_audit.py [data_dir] > PLANS.md

For each query with a SQL oracle (the relational ones; the model queries
fit MLlib estimators and are left out): shuffles, broadcasts, scans with
their read schema and pushed filters, and any plan node that would be a
problem at scale (Python evaluation, cartesian products, nested-loop joins).
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BAD_NODES = (
    "BatchEvalPython",
    "ArrowEvalPython",
    "FlatMapGroupsInPandas",
    "MapInPandas",
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
)


# These fit models while they are built; their plans are MLlib's.
FITTING = {
    "fit_logistic", "fit_logistic_notebook", "fit_forest", "fit_forest_notebook", "fit_boosting",
    "predict", "feature_importance", "cross_validate", "grid_search", "risk_flow",
}


def relational(names) -> list[str]:
    """Without the queries that fit models and the optional ones."""
    return sorted(n for n in names if n not in FITTING and n != "pipeline" and not re.match(r"op\d+_", n))


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def audit(df) -> dict:
    text = plan_text(df)
    head = text.split("\n\n(1)")[0]
    return {
        "shuffles": len(re.findall(r"^\(\d+\) Exchange\b", text, flags=re.M)),
        "broadcasts": len(re.findall(r"^\(\d+\) BroadcastExchange\b", text, flags=re.M)),
        "windows": len(re.findall(r"^\(\d+\) Window\b", text, flags=re.M)),
        "scans": sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", text))),
        "pushed": sorted(set(p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", text) if p)),
        "bad": [n for n in BAD_NODES if n in text],
        "tree": head,
    }


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    data_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    qs = e.queries()
    print("# Plan audit\n")
    print(f"Physical plans (before adaptive re-planning) of the relational queries on `{data_dir}`.")
    print("Generated by `python tests/plan_audit.py`.\n")
    print("| query | shuffles | broadcasts | windows | scans (read schema) | pushed filters | flagged |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    trees = []
    for name in relational(e.oracle_sql()):
        a = audit(qs[name](spark, data_dir))
        scans = "<br>".join(s.replace("|", "/") for s in a["scans"])
        pushed = "<br>".join(a["pushed"])
        print(f"| {name} | {a['shuffles']} | {a['broadcasts']} | {a['windows']} | {scans} | {pushed} | {', '.join(a['bad']) or '-'} |")
        trees.append((name, a["tree"]))
    print("\n## Plan trees\n")
    for name, tree in trees:
        print(f"### {name}\n\n```\n{tree.strip()}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
