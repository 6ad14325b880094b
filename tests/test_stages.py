import os
import subprocess
import sys

from pyspark.sql import functions as F

from riskframe.plans.stages import query_times, stage_times

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import sys
from riskframe.plans.scaling import timed
from riskframe.plans.stages import LOG_SETTINGS, named, stage_times
from riskframe.session import local_session

spark = local_session(2, "stages", **{k.replace(".", "__"): v for k, v in LOG_SETTINGS.items()}, spark__eventLog__dir=sys.argv[1])
spark.conf.set("spark.sql.adaptive.enabled", "false")
spark.conf.set("spark.sql.shuffle.partitions", "3")
rows = spark.range(0, 1000, 1, 4)
with named(spark, "two stages"):
    timed(rows.groupBy((rows.id % 7).alias("k")).count())
with named(spark, "one stage"):
    timed(rows)
    with named(spark, "inner"):
        timed(rows)
    timed(rows)
timed(rows)
assert stage_times(spark).count() == 6
spark.stop()
"""


def test_stages_of_named_queries(spark, tmp_path):
    env = {**os.environ, "PYTHONPATH": ROOT}
    subprocess.run([sys.executable, "-c", PROGRAM, str(tmp_path)], check=True, env=env, timeout=300)
    stages = stage_times(spark, f"{tmp_path}/*")
    rows = {}
    for r in stages.orderBy("stage").collect():
        rows.setdefault(r["query"], []).append(r)
    own = {q: [r["tasks"] for r in some] for q, some in rows.items() if q}
    assert own == {"two stages": [4, 3], "one stage": [4, 4], "inner": [4]}
    assert rows[None][0]["tasks"] == 4  # then come those of the program's own look at the log
    first, second = rows["two stages"]
    assert first["shuffle_write_mb"] > 0 and second["shuffle_read_mb"] == first["shuffle_write_mb"]
    assert all(r["failed"] == 0 and r["spill_mb"] == 0 for some in rows.values() for r in some)
    assert all(0 < r["longest_task"] <= r["seconds"] for some in rows.values() for r in some)
    totals = {r["query"]: r for r in query_times(stages).collect()}
    assert totals["two stages"]["stages"] == 2 and totals["two stages"]["tasks"] == 7
    assert {s["stage"] for s in totals["two stages"]["longest"]} == {first["stage"], second["stage"]}


def test_a_cut_off_line_is_left_out(spark, tmp_path):
    (tmp_path / "log").write_text('{"Event":"SparkListenerTaskEnd","Stage ID":1,"Task Inf')
    assert stage_times(spark, str(tmp_path)).agg(F.count("stage")).first()[0] == 0
