"""Landing log of fetched payloads, as a Spark data source for batches and streams.

A fetcher appends one line per payload, a JSON object of ``payload_no``, ``landed_at`` (microseconds since 1970) and
``payload``, to ``<folder>/<feed>/<segment>.jsonl``.  Segments of a feed follow each other by name and only the last one
grows, so how far a reader is takes one segment and one place per feed, whatever has landed.  Spark's own file streams take
a file once and never see lines added to it later.

    spark.dataSource.register(FeedLog)
    spark.read.format("feed_log").load(folder)
    spark.readStream.format("feed_log").option("feeds", "hn,reddit").load(folder)
    payloads.write.format("feed_log").mode("append").save(folder)

Rows: ``feed``, ``segment``, ``at`` (the line's first byte, so that the three name a line), ``payload_no``, ``landed_at``,
``payload``, and ``malformed``: the line itself where it is no such object.  Empty lines are no rows.  The last line of the
last segment counts once it has its line end.  A folder that is not there is an empty log.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "feed string, segment string, at bigint, payload_no bigint, landed_at timestamp, payload string, malformed string"
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
FEED_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")
ENDING = ".jsonl"


@dataclass
class Piece(InputPartition):
    """The lines of a segment that start from ``low`` up to ``high``; ``first`` if a line is known to start at ``low``."""

    feed: str
    segment: str
    low: int
    high: int
    first: bool


@dataclass
class Drafts(WriterCommitMessage):
    """Files that a task has written: (feed, path)."""

    files: list


class Log:
    """Files of a log, in any store that Arrow opens."""

    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.feeds = {f.strip() for f in options["feeds"].split(",")} if options.get("feeds") else None

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def segments(self) -> dict[str, list[tuple[str, int]]]:
        """Names and sizes of the segments of every feed, in order."""
        from pyarrow import fs

        store, root = self.store()
        found: dict[str, list[tuple[str, int]]] = {}
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            feed = info.base_name
            if info.type != fs.FileType.Directory or not FEED_NAME.fullmatch(feed) or (self.feeds is not None and feed not in self.feeds):
                continue
            files = store.get_file_info(fs.FileSelector(info.path))
            found[feed] = sorted((f.base_name[: -len(ENDING)], f.size) for f in files if f.is_file and f.base_name.endswith(ENDING))
        return {feed: names for feed, names in found.items() if names}

    def file(self, feed: str, segment: str) -> str:
        return f"{self.store()[1]}/{feed}/{segment}{ENDING}"

    def end(self) -> dict:
        """Where each feed ends now, behind the last whole line."""
        return {feed: {"segment": names[-1][0], "at": self._whole(feed, *names[-1])} for feed, names in self.segments().items()}

    def _whole(self, feed: str, segment: str, size: int, step: int = 1 << 16) -> int:
        """Bytes of a growing segment up to its last line end, looked for from its end."""
        with self.store()[0].open_input_file(self.file(feed, segment)) as file:
            high = size
            while high:
                low = max(0, high - step)
                place = file.read_at(high - low, low).rfind(b"\n")
                if place >= 0:
                    return low + place + 1
                high = low
        return 0

    def pieces(self, start: dict, end: dict) -> list[Piece]:
        """What lies between two places, cut to pieces of ``split`` bytes."""
        found, held = [], self.segments()
        for feed, last in sorted(end.items()):
            since = start.get(feed, {"segment": "", "at": 0})
            for segment, size in held.get(feed, []):
                if not since["segment"] <= segment <= last["segment"]:
                    continue
                low = since["at"] if segment == since["segment"] else 0
                high = last["at"] if segment == last["segment"] else size
                found += [Piece(feed, segment, at, min(at + self.split, high), at == low) for at in range(low, high, self.split)]
        return found

    def read(self, piece: Piece) -> Iterator:
        """Rows of a piece as Arrow batches of a few megabytes."""
        import pyarrow as pa

        kind = pa.schema([
            ("feed", pa.string()), ("segment", pa.string()), ("at", pa.int64()), ("payload_no", pa.int64()), ("landed_at", pa.timestamp("us", tz="UTC")),
            ("payload", pa.string()), ("malformed", pa.string()),
        ])
        rows, held = [], 0

        def batch():
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind)], schema=kind)

        with self.store()[0].open_input_file(self.file(piece.feed, piece.segment)) as raw, io.BufferedReader(raw, 1 << 20) as file:
            at = piece.low
            if not piece.first:
                # a line that starts before the piece belongs to the one before; it may end with the byte before this piece,
                # or go on beyond it, which leaves no line to this one
                file.seek(at - 1)
                at += len(file.readline(piece.high - at + 1)) - 1
            else:
                file.seek(at)
            while at < piece.high:
                line = file.readline()
                if not line:
                    break
                if line.strip():
                    rows.append((piece.feed, piece.segment, at, *parse(line)))
                    held += len(line)
                    if held >= BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
                at += len(line)
        if rows:
            yield batch()


def parse(line: bytes) -> tuple:
    """(payload_no, landed_at, payload, malformed) of a line."""
    text = line.decode(errors="replace").rstrip("\r\n")
    try:
        found = json.loads(text)
        number, landed, payload = found["payload_no"], found.get("landed_at"), found["payload"]
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
        return None, None, None, text
    whole = lambda x: x is None or (type(x) is int and -(1 << 63) <= x < 1 << 63)
    if not whole(number) or not whole(landed):
        return None, None, None, text
    if payload is not None and not isinstance(payload, str):
        payload = json.dumps(payload)  # a payload that was not put in quotes
    # half of a surrogate pair is valid in JSON but no text
    return number, landed, payload if payload is None else payload.encode(errors="replace").decode(), None


class BatchReader(DataSourceReader):
    def __init__(self, log: Log):
        self.log = log

    def partitions(self):
        return self.log.pieces({}, self.log.end())

    def read(self, partition):
        return self.log.read(partition) if isinstance(partition, Piece) else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, log: Log):
        self.log = log

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.log.end()

    def partitions(self, start: dict, end: dict):
        return self.log.pieces(start, end)

    def read(self, partition):
        return self.log.read(partition)


class Writer(DataSourceWriter):
    """Each write adds segments behind the last of each feed; lines show once they are moved there, one file at a time.

    Rows need ``feed``, ``payload_no`` and ``payload``, may have ``landed_at``; other columns are left out.  One writer at a
    time; a job that is started again lands its payloads a second time, and candidates keep the first of an id.
    """

    def __init__(self, log: Log):
        self.log, self.drafts = log, f"_drafts/{uuid.uuid4().hex}"

    def write(self, iterator) -> Drafts:
        store, root = self.log.store()
        base, files = f"{root}/{self.drafts}/{uuid.uuid4().hex}", {}
        try:
            for row in iterator:
                if not FEED_NAME.fullmatch(row["feed"] or ""):
                    raise ValueError(f"no name of a feed: {row['feed']!r}")
                if row["feed"] not in files:
                    store.create_dir(base)
                    files[row["feed"]] = io.BufferedWriter(store.open_output_stream(f"{base}/{row['feed']}{ENDING}"), 1 << 20)
                landed = row["landed_at"] if "landed_at" in row.__fields__ else None
                line = {"payload_no": row["payload_no"], "landed_at": None if landed is None else micros(landed), "payload": row["payload"]}
                files[row["feed"]].write(json.dumps(line).encode() + b"\n")
        finally:
            for file in files.values():
                file.close()
        return Drafts([(feed, f"{base}/{feed}{ENDING}") for feed in files])

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, root = self.log.store()
        # all feeds of the folder count, whatever the options choose
        last = {feed: names[-1][0] for feed, names in Log({"path": self.log.folder}).segments().items()}
        numbers = {feed: int(name) if name.isdigit() else None for feed, name in last.items()}
        for feed, draft in (f for m in messages if m is not None for f in m.files):
            number = numbers.get(feed, -1)
            if number is None:
                raise ValueError(f"segments of {feed} have no numbers to count on from: {last[feed]}")
            numbers[feed] = number + 1
            target = f"{root}/{feed}/{number + 1:012d}{ENDING}"
            store.create_dir(f"{root}/{feed}")
            if store.get_file_info(target).type != fs.FileType.NotFound:
                raise FileExistsError(target)
            store.move(draft, target)
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, root = self.log.store()
        if store.get_file_info(f"{root}/{self.drafts}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.drafts}")


def micros(time) -> int:
    """Microseconds since 1970 of a time as Spark hands it to Python: local where it carries no zone."""
    from datetime import datetime, timedelta, timezone

    return (time.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


class FeedLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(Log(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(Log(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a landing log is only appended to")
        return Writer(Log(self.options))


def _reader(reader, folder: str, feeds: list[str] | None, split_bytes: int) -> DataFrame:
    chosen = reader.format("feed_log").option("splitBytes", split_bytes)
    return (chosen.option("feeds", ",".join(feeds)) if feeds else chosen).load(folder)


def read_log(spark: SparkSession, folder: str, feeds: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All lines landed so far."""
    spark.dataSource.register(FeedLog)
    return _reader(spark.read, folder, feeds, split_bytes)


def stream_log(spark: SparkSession, folder: str, feeds: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines as they land; a batch takes all that is there, cut to pieces of ``split_bytes``.

    With ``availableNow`` a run that finds an unfinished batch does that one again; the next run takes what came after.
    """
    spark.dataSource.register(FeedLog)
    return _reader(spark.readStream, folder, feeds, split_bytes)


def land(payloads: DataFrame, folder: str) -> None:
    """Append payloads (feed, payload_no, payload, and landed_at if there) to a log."""
    payloads.sparkSession.dataSource.register(FeedLog)
    names = [n for n in ("feed", "payload_no", "payload", "landed_at") if n in payloads.columns]
    payloads.select(*names).write.format("feed_log").mode("append").save(folder)


def payloads_of(log: DataFrame, feed: str) -> DataFrame:
    """Payloads of one feed as ``landing.candidates`` takes them; malformed lines and null payloads have no items."""
    return log.filter((F.col("feed") == feed) & F.col("payload").isNotNull()).select("payload_no", "payload")
