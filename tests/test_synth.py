"""Records made from events."""

import re

from loomlog.plans import synth


def test_records_are_made_by_compiled_code(spark):
    """The JVM compiles no method of more than 8000 bytes; such a one is interpreted for every record."""
    events = spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = synth.log_records(events)._jdf.queryExecution()
        shown = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
    assert sizes and max(sizes) < 8000, sizes
