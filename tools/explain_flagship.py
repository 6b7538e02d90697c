"""Print the flagship's physical plan as a large cluster would plan it
(no AQE re-planning, no size-based broadcast), one operator per line."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    from babelfold.plans.queries import queries
    from babelfold.session import get_session

    spark = get_session()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    df = queries()["translate_pages"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for ln in plan.splitlines():
        ln = re.sub(r"#\d+L?", "", ln)
        m = re.match(r"^([\s:+\-*()0-9]*)(\w[\w ]*?)(?=[\s\[(]|$)(.*)$", ln)
        if not m:
            continue
        head, op, rest = m.groups()
        keep = ""
        if op in ("Exchange", "ShuffledHashJoin", "SortMergeJoin", "HashAggregate", "SortAggregate",
                  "ObjectHashAggregate", "Window", "Sort"):
            keep = rest.strip()[:110]
        elif op == "FileScan parquet" or op.startswith("FileScan"):
            keep = re.sub(r"Location: [^,]*,", "", rest)[:110]
        print(f"{head}{op} {keep}".rstrip())


if __name__ == "__main__":
    main()
