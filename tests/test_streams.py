"""Streams over several runs of one job: restarts, alerts once, expiring state."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsgraph.streaming import keyed, streams as ST

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def land(spark, folder, number, rows):
    """rows: (event_id, hours after START, user, type, value)."""
    data = [(i, START + timedelta(hours=h), u, kind, float(v), f'{{"k": {i}}}') for i, h, u, kind, v in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet" if number is None else f"{folder}/events-{number}.parquet")


def stream(spark, folder):
    return ST.read_landing(spark, folder, "events")


def landing(spark, tmp_path, rows):
    folder = str(tmp_path / "in")
    land(spark, folder, None, rows)
    return folder


def test_an_append_job_goes_on_where_it_ended(spark, tmp_path):
    folder, work = landing(spark, tmp_path, [(1, 0, 1, "click", 5), (2, 1, 1, "click", 6)]), str(tmp_path / "work")
    job = lambda: ST.drain_append(stream(spark, folder).select("event_id"), work)
    assert sorted(r.event_id for r in job().collect()) == [1, 2]
    assert sorted(r.event_id for r in job().collect()) == [1, 2]
    land(spark, folder, None, [(3, 2, 1, "click", 7)])
    assert sorted(r.event_id for r in job().collect()) == [1, 2, 3]


def test_alerts_are_sent_once_in_their_days(spark, tmp_path):
    folder, work = landing(spark, tmp_path, [(1, 0, 1, "click", 200), (2, 1, 1, "click", 300), (3, 1, 2, "click", 5)]), str(tmp_path / "work")
    job = lambda: ST.alert_once(stream(spark, folder), work, "user_id", F.col("value") >= 100, ["user_id", "event_id"], days=30)
    assert sorted(tuple(r) for r in job().collect()) == [(1, 1)]
    land(spark, folder, None, [(4, 5, 1, "click", 900), (5, 6, 2, "click", 150)])
    assert sorted(tuple(r) for r in job().collect()) == [(1, 1), (2, 5)]
    land(spark, folder, None, [(6, 24 * 40, 1, "click", 900)])
    assert sorted(tuple(r) for r in job().collect()) == [(1, 1), (1, 6), (2, 5)]


def test_maxima_expire(spark, tmp_path):
    folder, work = landing(spark, tmp_path, [(1, 0, 1, "click", 50), (2, 1, 2, "click", 60)]), str(tmp_path / "work")

    def job():
        rows = ST.running_maxima(stream(spark, folder), "user_id", {"top": F.col("value")}, days=10)
        return {r.user_id: r.top for r in ST.drain_update(rows, work, ["user_id"]).collect()}

    assert job() == {1: 50.0, 2: 60.0}
    land(spark, folder, None, [(3, 24, 1, "click", 20)])
    assert job() == {1: 50.0, 2: 60.0}  # the larger value is kept
    land(spark, folder, None, [(4, 24 * 60, 2, "click", 1)])
    job()  # moves the watermark past the expiry of the first key
    land(spark, folder, None, [(5, 24 * 61, 1, "click", 7)])
    assert job()[1] == 7.0  # forgotten: starts anew


def test_newest_value(spark, tmp_path):
    folder, work = landing(spark, tmp_path, [(1, 5, 1, "click", 1), (2, 5, 1, "click", 1), (3, 4, 1, "click", 1)]), str(tmp_path / "work")
    job = lambda: ST.drain_update(ST.newest_values(stream(spark, folder), "user_id", "props"), work, ["user_id"])
    assert [r.props for r in job().collect()] == ['{"k": 2}']
    land(spark, folder, None, [(4, 3, 1, "click", 1)])
    values = job()
    assert [r.props for r in values.collect()] == ['{"k": 2}']
    at = F.lit(START + timedelta(days=7, hours=5))
    assert ST.live_values(values, at - F.expr("interval 1 second")).count() == 1 and ST.live_values(values, at).count() == 0


def test_late_rows_do_not_reach_state(spark, tmp_path):
    folder, work = landing(spark, tmp_path, [(1, 24 * 60, 1, "click", 50)]), str(tmp_path / "work")

    def job():
        rows = ST.running_maxima(stream(spark, folder), "user_id", {"top": F.col("value")}, days=10)
        return {r.user_id: r.top for r in ST.drain_update(rows, work, ["user_id"]).collect()}

    assert job() == {1: 50.0}
    land(spark, folder, None, [(2, 24 * 60, 3, "click", 1)])
    job()  # the watermark now stands a week before the first row
    land(spark, folder, None, [(3, 24 * 50, 1, "click", 900), (4, 24 * 55, 1, "click", 60)])
    assert job() == {1: 60.0, 3: 1.0}  # ten days late: left out; five days late: counted


def test_alerts_of_one_batch_keep_their_distance(spark, tmp_path):
    rows = [(i, 24 * day, 1, "click", 500) for i, day in enumerate([0, 1, 30, 31, 61])] + [(9, 3, 2, "click", None or 1)]
    folder, work = landing(spark, tmp_path, rows), str(tmp_path / "work")
    got = ST.alert_once(stream(spark, folder), work, "user_id", F.col("value") >= 100, ["user_id", "event_id"], days=30)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0), (1, 2), (1, 4)]


def test_ring_of_the_last_records(spark, tmp_path):
    folder, work = landing(spark, tmp_path, [(i, i, 1, "a", i) for i in range(5)] + [(50, 9, 1, "b", 7)]), str(tmp_path / "work")

    def job():
        rows = keyed.latest_records(stream(spark, folder), "event_type", F.col("value"), 3)
        return {r.event_type: (r.records, r.total, r.oldest) for r in ST.drain_update(rows, work, ["event_type"]).collect()}

    assert job() == {"a": (3, 9, 2), "b": (1, 7, 50)}
    land(spark, folder, None, [(60, 1, 1, "a", 100), (61, 20, 1, "a", 1000)])  # one of them older than all that is kept
    assert job() == {"a": (3, 1007, 3), "b": (1, 7, 50)}
    assert job() == {"a": (3, 1007, 3), "b": (1, 7, 50)}
