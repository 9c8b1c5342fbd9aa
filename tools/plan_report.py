"""Write PLANS.md: the physical plan of every registered batch query.

Usage: python tools/plan_report.py [sf_dir]   (default: sf0.1)
Streaming queries are run by their callables and return a read of their sink,
so their stream plans are described in the README instead.
"""

from __future__ import annotations

import io
import sys
from contextlib import redirect_stdout
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from shopflow.session import build_session  # noqa: E402

STREAMS = {"orders_in_stock_stream", "order_and_event_sinks", "notification_outbox",
           "event_stream_source", "interval_rollup_stream", "notification_dead_letters", "order_to_notification",
           "product_append", "order_append", "event_publish"}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=16)
    from shopflow.queries import QUERIES
    out = ["# Physical plans", "",
           f"Generated by `tools/plan_report.py` at `{sf_dir}` (`local[8]`, 16 shuffle partitions,",
           "AQE on: the final plan may coalesce partitions or split skewed ones at run time).",
           "Sink and stream queries are left out (their callables run the job and read the sink).", ""]
    for name, fn in sorted(QUERIES.items()):
        if name in STREAMS:
            continue
        buf = io.StringIO()
        with redirect_stdout(buf):
            fn(spark, sf_dir).explain()
        plan = buf.getvalue().replace(sf_dir, "<sf>")
        out += [f"## {name}", "", "```", plan.strip(), "```", ""]
    (ROOT / "PLANS.md").write_text("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
