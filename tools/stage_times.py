"""Run catalog keys with Spark's event log on and print per-stage times.

    python tools/stage_times.py SF_DIR EVENT_DIR key [key ...]

The event log goes to EVENT_DIR (a scratch folder); stage wall times,
task counts and shuffle bytes are read back from it.  No UI is started.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv):
    sf_dir, ev_dir, keys = argv[1], argv[2], argv[3:]
    os.environ.setdefault("CARRYLENS_MASTER", "local[8]")
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(os.environ["CARRYLENS_MASTER"]).appName("stage-times")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", ev_dir)
             .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "16").config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate())
    from carrylens.plans.catalog import QUERIES
    from carrylens.plans.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    app = spark.sparkContext.applicationId
    marks = []
    for k in keys:
        for rep in range(2):
            t0 = time.time()
            spark.sparkContext.setJobDescription(f"{k}#{rep}")
            QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            marks.append((k, rep, t0, time.time()))
    spark.stop()
    path = [p for p in glob.glob(os.path.join(ev_dir, "*")) if app in p][0]
    stages = {}
    jobs = {}
    files = sorted(glob.glob(os.path.join(path, "*"))) if os.path.isdir(path) else [path]
    lines = [ln for f in files for ln in open(f)]
    for line in lines:
        e = json.loads(line)
        ev = e.get("Event")
        if ev == "SparkListenerJobStart":
            desc = (e.get("Properties") or {}).get("spark.job.description", "")
            for sid in e.get("Stage IDs", []):
                jobs[sid] = desc
        elif ev == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            dur = (info.get("Completion Time", 0) - info.get("Submission Time", 0)) / 1000
            shuffle_w = 0
            for acc in info.get("Accumulables", []):
                if acc.get("Name") == "internal.metrics.shuffle.write.bytesWritten":
                    shuffle_w = int(acc.get("Value", 0))
            stages[info["Stage ID"]] = (info["Stage Name"][:60], info["Number of Tasks"], dur, shuffle_w)
    for k, rep, t0, t1 in marks:
        print(f"== {k} run {rep}: {t1 - t0:.2f}s")
        if rep == 1:
            for sid, (name, n, dur, sw) in sorted(stages.items()):
                if jobs.get(sid) == f"{k}#{rep}":
                    print(f"   stage {sid:4d} tasks={n:3d} {dur:6.2f}s shuffle_write={sw / 1e6:7.2f}MB  {name}")


if __name__ == "__main__":
    main(sys.argv)
