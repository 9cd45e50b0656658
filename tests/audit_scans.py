"""Count full passes over the big input tables per registered query, from Spark's event log.

usage: python tests/audit_scans.py [sf_dir] [query ...]

Each query runs to completion (noop sink) after a marker job; the stages between
two markers belong to that query. A stage whose input record count equals a
table's row count is a full pass over it. The event log goes to a fresh scratch
folder; nothing is read from the Spark UI.
"""

from __future__ import annotations

import glob
import itertools
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    import pyarrow.parquet as pq
    rows = {t: pq.ParquetFile(f"{sf_dir}/{t}.parquet").metadata.num_rows for t in ("lineitem", "orders")}
    evdir = tempfile.mkdtemp(prefix="riskpanel-eventlog-")
    from riskpanel.session import get_session
    import __spark_entry__ as E
    spark = get_session("local[8]", 8, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": evdir,
                                              "spark.eventLog.compress": "false"})
    qs = E.queries()
    names = sys.argv[2:] or list(qs)
    secs = {}
    for name in names:
        spark.sparkContext.setJobGroup("marker:" + name, "marker")
        spark.range(1).collect()
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        secs[name] = time.perf_counter() - t0
    spark.stop()
    files = sorted(glob.glob(evdir + "/**/events_*", recursive=True),
                   key=lambda p: int(os.path.basename(p).split("_")[1]))
    markers, stage_rows = [], {}
    for line in itertools.chain.from_iterable(open(f) for f in files):
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id") or ""
            if g.startswith("marker:") and e["Stage IDs"]:
                markers.append((min(e["Stage IDs"]), g[7:]))
        elif e["Event"] == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            acc = {a["Name"]: a.get("Value") for a in si.get("Accumulables", [])}
            stage_rows[si["Stage ID"]] = int(acc.get("internal.metrics.input.recordsRead") or 0)
    markers.sort()
    passes = {n: {t: 0 for t in rows} for n in names}
    for sid, n_in in stage_rows.items():
        owner = None
        for first, name in markers:
            if first < sid:
                owner = name
        for t, n in rows.items():
            if owner in passes and n_in == n:
                passes[owner][t] += 1
    for name in names:
        print(json.dumps({"query": name, "sec": round(secs[name], 2), **{f"{t}_passes": v
                                                                        for t, v in passes[name].items()}}))


if __name__ == "__main__":
    main()
