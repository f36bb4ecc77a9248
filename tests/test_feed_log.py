import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from newsgraph.sources import feed_log as L
from newsgraph.streaming import streams as ST

KEYS = ["feed", "segment", "at", "payload_no", "landed_at", "payload", "malformed"]


def line(number, payload, landed=None):
    return json.dumps({"payload_no": number, "payload": payload, "landed_at": landed}) + "\n"


def add(folder, feed, segment, text):
    at = folder / feed
    at.mkdir(parents=True, exist_ok=True)
    with open(at / f"{segment}.jsonl", "a", encoding="utf-8", newline="") as file:
        file.write(text)


def plain(folder, feeds=None):
    """All whole lines, by a loop; the last segment's last line only with its end."""
    rows = []
    for feed in sorted(p for p in folder.iterdir() if p.is_dir() and not p.name.startswith("_")):
        if feeds and feed.name not in feeds:
            continue
        files = sorted(feed.glob("*.jsonl"))
        for file in files:
            at = 0
            for raw in file.read_bytes().splitlines(keepends=True):
                if raw.strip() and (raw.endswith(b"\n") or file != files[-1]):
                    rows.append((feed.name, file.stem, at, *L.parse(raw)[:1], raw.decode()))
                at += len(raw)
    return sorted(rows)


def got(df):
    return sorted((r.feed, r.segment, r.at, r.payload_no) for r in df.collect())


def fill(folder, seed, rows, feeds=("hn", "rss", "reddit")):
    rng = random.Random(seed)
    for i in range(rows):
        text = "".join(rng.choice("aé\n\"日x ") for _ in range(rng.choice([0, 3, 40, 900])))
        add(folder, rng.choice(feeds), f"{rng.randint(seed, seed + 1):04d}", line(i, text, 1_700_000_000_000_000 + i) if rng.random() < 0.9 else rng.choice(["\n", "{oops\n", "[1]\n"]))


@pytest.mark.parametrize("split", [1, 97, 5000, 1 << 25])
def test_pieces_cover_every_line_once(spark, tmp_path, split):
    fill(tmp_path, 1, 60)
    add(tmp_path, "hn", "0009", line(1, "whole") + '{"payload_no": 7')
    pieces = L.Log({"path": str(tmp_path), "splitbytes": str(split)})
    found = [r for p in pieces.pieces({}, pieces.end()) for b in pieces.read(p) for r in b.to_pylist()]
    assert sorted((r["feed"], r["segment"], r["at"], r["payload_no"]) for r in found) == [r[:4] for r in plain(tmp_path)]


def test_batch(spark, tmp_path):
    fill(tmp_path, 1, 200)
    df = L.read_log(spark, str(tmp_path), split_bytes=700)
    assert df.columns == KEYS
    assert got(df) == [r[:4] for r in plain(tmp_path)]
    assert got(L.read_log(spark, str(tmp_path), feeds=["hn", "nothing"])) == [r[:4] for r in plain(tmp_path, ["hn"])]
    for r in df.collect():
        if r.malformed is None:
            assert r.landed_at.astimezone(timezone.utc).year == 2023 and r.payload is not None
        else:
            assert r.payload_no is None and r.payload is None and r.malformed in ("{oops", "[1]")


def test_lines_of_all_kinds(spark, tmp_path):
    odd = [line(1, None), line(2, {"a": [1]}), line(None, "x"), line("3", "x"), line(4, "x", "today"), line(1 << 70, "x"), '{"payload_no": 5}\n', "null\n", '{"payload_no": 6, "payload": "\\ud800"}\r\n']
    add(tmp_path, "hn", "1", "".join(odd))
    add(tmp_path, "hn", "1", line(9, "y" * 3_000_000))
    add(tmp_path, "hn", "2", "")
    rows = {r.at: r for r in L.read_log(spark, str(tmp_path), split_bytes=20_000).collect()}
    shown = [(r.payload_no, r.payload if r.payload is None else r.payload[:8], r.malformed is not None) for _, r in sorted(rows.items())]
    assert shown == [(1, None, False), (2, '{"a": [1', False), (None, "x", False), (None, None, True), (None, None, True), (None, None, True), (None, None, True), (None, None, True),
                     (6, "?", False), (9, "yyyyyyyy", False)]


def test_empty_logs(spark, tmp_path):
    assert L.read_log(spark, str(tmp_path / "nowhere")).collect() == []
    (tmp_path / "hn").mkdir()
    (tmp_path / "hn" / "notes.txt").write_text("no segment\n")
    assert L.read_log(spark, str(tmp_path)).collect() == []


def test_stream_takes_what_is_added_once_over_restarts(spark, tmp_path):
    log, work = tmp_path / "log", str(tmp_path / "work")
    log.mkdir()
    run = lambda: ST.drain_append(L.stream_log(spark, str(log), split_bytes=900), work)
    add(log, "hn", "0001", line(1, "a") + line(2, "b")[:9])
    assert got(run()) == [("hn", "0001", 0, 1)]
    # the cut line goes on, the segment is followed by others, and a feed joins
    add(log, "hn", "0001", line(2, "b")[9:])
    fill(log, 2, 80)
    assert got(run()) == [r[:4] for r in plain(log)]
    assert got(run()) == [r[:4] for r in plain(log)]
    # a segment that ended without a line end is closed by the next one
    add(log, "rss", "0007", line(3, "c").rstrip("\n"))
    assert got(run()) == [r[:4] for r in plain(log)]
    fill(log, 8, 50)
    assert got(run()) == [r[:4] for r in plain(log)]
    assert got(L.read_log(spark, str(log))) == got(run())


def test_a_failed_batch_is_read_again(spark, tmp_path):
    log, work = tmp_path / "log", str(tmp_path / "work")
    fill(log, 1, 40)
    seen, fail = [], [True]

    def store(batch, number):
        if fail[0]:
            raise RuntimeError("lost")
        seen.extend(got(batch))

    def run():
        query = L.stream_log(spark, str(log)).writeStream.foreachBatch(store).option("checkpointLocation", work).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    before = [r[:4] for r in plain(log)]
    fill(log, 4, 30)
    fail[0] = False
    run()
    assert sorted(seen) == before  # the batch that failed, as it was
    run()
    assert sorted(seen) == [r[:4] for r in plain(log)] and len(before) < len(seen)


def test_land_appends_segments(spark, tmp_path):
    folder = str(tmp_path / "log")
    when = datetime(2024, 5, 6, 7, 8, 9, 123456, tzinfo=timezone.utc)
    rows = spark.createDataFrame([("hn", 1, "p\n1", when, 5), ("rss", 2, None, None, 5), ("hn", None, "p3", when, 5)], "feed string, payload_no long, payload string, landed_at timestamp, extra int")
    L.land(rows.repartition(3), folder)
    L.land(rows.drop("landed_at"), folder)
    L.land(rows.limit(0), folder)
    df = L.read_log(spark, folder)
    shown = lambda d: sorted((r.feed, r.payload_no or 0, r.payload or "", r.us or 0) for r in d.select("*", F.unix_micros("landed_at").alias("us")).collect())
    us = int(when.timestamp()) * 1_000_000 + 123456
    assert shown(df) == sorted([("hn", 1, "p\n1", us), ("hn", 1, "p\n1", 0), ("rss", 2, "", 0), ("rss", 2, "", 0), ("hn", 0, "p3", us), ("hn", 0, "p3", 0)])
    names = sorted(p.name for p in (tmp_path / "log" / "hn").iterdir())
    assert names == [f"{i:012d}.jsonl" for i in range(len(names))]
    assert sorted((r.payload_no or 0, r.payload) for r in L.payloads_of(df, "hn").collect()) == [(0, "p3"), (0, "p3"), (1, "p\n1"), (1, "p\n1")]
    assert L.payloads_of(df, "rss").count() == 0


def test_a_failed_write_leaves_the_log(spark, tmp_path):
    folder = tmp_path / "log"
    good = spark.createDataFrame([("hn", 1, "a")], "feed string, payload_no long, payload string")
    L.land(good, str(folder))
    bad = spark.createDataFrame([("hn", 2, "b"), ("../hn", 3, "c")], "feed string, payload_no long, payload string")
    with pytest.raises(Exception, match="no name of a feed"):
        L.land(bad, str(folder))
    assert [r.payload_no for r in L.read_log(spark, str(folder)).collect()] == [1]
    assert [p for p in (folder / "_drafts").rglob("*") if p.is_file()] == []
    with pytest.raises(Exception, match="only appended"):
        good.write.format("feed_log").mode("overwrite").save(str(folder))
