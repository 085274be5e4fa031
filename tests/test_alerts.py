"""Alerts over a stream against a plain walk through the batches, replayed and stopped half way."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.streaming import alerts as A

RULE = {"near": ("near", "ship", True, "enter", None, None, None, None, 0.0, 0.0, 10.0, 10.0, None), "fast": ("fast", "ship", True, "score_above", None, "speed", 50.0, None, None, None, None, None, None), "many": ("many", "ship", True, "count_exceeds", 3, None, None, None, 0.0, 0.0, 10.0, 10.0, None), "code": ("code", "air", True, "squawk_equals", None, None, None, "7700", None, None, None, None, None)}
SCHEMA = A.FIX + ", speed double"


def fires(rule, state):
    """Subjects a rule fires for, by hand."""
    inside = [(e, r) for e, r in state.items() if r["layer"] == rule[1] and (rule[8] is None or (r["lat"] is not None and rule[8] <= r["lat"] <= rule[10] and rule[9] <= r["lon"] <= rule[11]))]
    if rule[3] == "count_exceeds":
        return {"*"} if len(inside) > rule[4] else set()
    test = {"enter": lambda r: True, "score_above": lambda r: r["speed"] is not None and r["speed"] > rule[6], "squawk_equals": lambda r: r["squawk"] == rule[7]}[rule[3]]
    return {str(e) for e, r in inside if test(r)}


def walk(batches, rules):
    """Alerts and changes after each batch."""
    state, alerts, changes, after = {}, {}, [], []
    for n, batch in enumerate(batches):
        for row in batch:
            if row["entity_id"] is not None and (row["entity_id"] not in state or (row["ts"], row["event_id"]) > (state[row["entity_id"]]["ts"], state[row["entity_id"]]["event_id"])):
                state[row["entity_id"]] = row
        if state:
            now = int(max(r["ts"] for r in state.values()))
            firing = {(r[0], s) for r in rules(n) if r[2] for s in fires(r, state)}
            for k in firing:
                first, times, gone = alerts.get(k, (now, 0, None))
                if k not in alerts or gone is not None:
                    changes.append((*k, "again" if k in alerts else "opened", n))
                    first = now
                alerts[k] = (first, times + 1, None)
            for k, (first, times, gone) in list(alerts.items()):
                if k not in firing and gone is None:
                    alerts[k] = (first, times, now)
                    changes.append((*k, "resolved", n))
        after.append(dict(alerts))
    return after, changes


def batches(seed, count=7):
    r, out = random.Random(seed), []
    for n in range(count):
        rows = []
        for i in range(0 if n == 0 else 12):
            rows.append({"entity_id": r.choice([*range(9), None]), "ts": 1000.0 * n + r.randint(-1500, 900), "event_id": n * 100 + i, "layer": r.choice(["ship", "ship", "air"]), "lat": r.choice([None, 5.0, 10.0, 40.0]), "lon": r.choice([0.0, 3.0, 30.0]), "country": None, "squawk": r.choice([None, "7700", "1200"]), "speed": r.choice([None, 10.0, 50.0, 80.0])})
        out.append(rows + rows[:2])  # repeated rows
    return out


def rules(n):
    """The rules change with the batches: `fast` is off in the third, `many` is gone in the fifth."""
    off = (*RULE["fast"][:2], False, *RULE["fast"][3:])
    return [RULE["near"], off if n == 2 else RULE["fast"], RULE["code"], *([] if n == 4 else [RULE["many"]])]


def shown(df):
    return {(r.rule, r.subject): (r.first_seen, r.occurrences, r.resolved_at) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_a_walk_and_replays_change_nothing(spark, tmp_path, seed):
    path, data = str(tmp_path / "kept"), batches(seed)
    sink, (after, changes) = A.alert_sink(path, rules, ("speed",)), walk(data, rules)
    for n, rows in enumerate(data):
        sink(spark.createDataFrame(rows, SCHEMA), n)
        if n in (1, 4):  # once more
            sink(spark.createDataFrame(rows[::-1], SCHEMA), n)
        assert shown(A.read(spark, path, n)) == after[n]
    got = [(r.rule, r.subject, r.change, r.batch) for r in A.changes(spark, path).collect()]
    assert sorted(got) == sorted(changes) and {c for *_, c, _ in got} == {"opened", "again", "resolved"}
    assert sorted(p.name for p in (tmp_path / "kept" / "state").iterdir() if p.is_dir()) == ["5", "6"]


def test_a_batch_that_fails_half_way_is_made_again(spark, tmp_path, monkeypatch):
    path, data = str(tmp_path / "kept"), batches(3, 5)
    sink, (after, changes) = A.alert_sink(path, rules, ("speed",)), walk(data, rules)
    for n, rows in enumerate(data):
        if n == 3:
            with monkeypatch.context() as m:
                m.setattr(A, "transitions", lambda *a: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    sink(spark.createDataFrame(rows, SCHEMA), n)
        sink(spark.createDataFrame(rows, SCHEMA), n)
    assert shown(A.read(spark, path, 4)) == after[4]
    assert sorted((r.rule, r.subject, r.change, r.batch) for r in A.changes(spark, path).collect()) == sorted(changes)


def test_a_stream_that_stops_and_goes_on(spark, tmp_path):
    path, feed, data = str(tmp_path / "kept"), str(tmp_path / "feed"), batches(4, 5)
    after, changes = walk(data[1:], rules)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(feed)
        q = stream.writeStream.foreachBatch(A.alert_sink(path, rules, ("speed",))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()

    for n, rows in enumerate(data[1:]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        run()
        assert shown(A.read(spark, path, n)) == after[n]
    run()  # nothing new, nothing counted
    assert shown(A.read(spark, path, len(after) - 1)) == after[-1]
    assert A.changes(spark, path).count() == len(changes)


def test_the_rules_fields_are_kept(spark, tmp_path):
    path = str(tmp_path / "kept")
    rows = [{"entity_id": 1, "ts": 5.0, "event_id": 1, "layer": "ship", "lat": None, "lon": None, "country": None, "squawk": None, "speed": 70.0}]
    A.alert_sink(path, lambda n: [RULE["fast"]], ("speed",))(spark.createDataFrame(rows, SCHEMA).withColumn("rule", F.lit("x")), 0)
    assert shown(A.read(spark, path, 0)) == {("fast", "1"): (5, 1, None)}
