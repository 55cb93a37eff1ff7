"""The ``mbox`` data source: MBOX files as rows, split by byte range; also as a stream and as a sink."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.headers import clamp, message_row
from ..schema import MESSAGE, RANGE_BYTES
from .files import expand, file_size, open_file
from .framing import headers_of, message_at, patch_mailbox, spans

_ADDRESS = pa.struct([("display_name", pa.string()), ("address", pa.string())])
ARROW = pa.schema(
    [("mailbox", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("date", pa.timestamp("us", "UTC")), ("from", _ADDRESS), ("to", pa.list_(_ADDRESS)), ("cc", pa.list_(_ADDRESS)), ("subject", pa.string()), ("message_id", pa.string()), ("in_reply_to", pa.string()), ("references", pa.list_(pa.string())), ("has_attachments", pa.bool_()), ("content_type", pa.string()), ("text_size", pa.int64()), ("labels", pa.list_(pa.string())), ("thread_id", pa.string()), ("part", pa.int32()), ("ordinal", pa.int64()), ("raw", pa.binary())]
)
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


@dataclass
class ByteRange(InputPartition):
    path: str
    begin: int
    end: int
    size: int
    patches: bool
    number: int


def read_range(part: ByteRange, with_raw: bool) -> Iterator[pa.RecordBatch]:
    with open_file(part.path) as f, open_file(part.path) as g:  # one place for the scan, one for the messages
        rows, held = [], 0
        for ordinal, (offset, length) in enumerate(spans(f, part.begin, part.end, part.size, part.patches)):
            raw = message_at(g, offset, length) if with_raw else None
            row = message_row(headers_of(g, offset, length))
            row |= {"date": clamp(row["date"]), "mailbox": part.path, "offset": offset, "length": length, "part": part.number, "ordinal": ordinal, "raw": raw}
            rows.append(row)
            held += length if with_raw else 2000
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


def byte_ranges(path: str, step: int, begin: int = 0, end: int | None = None, number: int = 0) -> list[ByteRange]:
    size = file_size(path)
    if not size:
        return []
    with open_file(path) as f:
        patches = patch_mailbox(f.readline(1 << 16))
    stop = size if end is None else min(end, size)
    return [ByteRange(path, a, min(a + step, stop), stop, patches, number + i) for i, a in enumerate(range(begin, stop, step))]


class MboxReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options.get("paths", "null")) or expand(options["path"])
        self.step = int(options.get("rangeBytes", RANGE_BYTES))
        self.raw = options.get("includeRaw", "false").lower() == "true"

    def partitions(self):
        out: list[ByteRange] = []
        for p in self.paths:
            out += byte_ranges(p, self.step, number=len(out))
        return out

    def read(self, partition):
        if isinstance(partition, ByteRange):
            yield from read_range(partition, self.raw)


class MboxTail(DataSourceStreamReader):
    """Follows one growing mailbox. A message is handed out once the next one has begun, so that its length is known."""

    def __init__(self, options):
        self.path = options["path"]
        self.step = int(options.get("rangeBytes", RANGE_BYTES))
        self.raw = options.get("includeRaw", "false").lower() == "true"

    def initialOffset(self):
        return {"offset": 0}

    def latestOffset(self):
        size = file_size(self.path)
        last = 0
        for part in byte_ranges(self.path, max(size, 1)):
            with open_file(self.path) as f:
                for offset, _ in spans(f, 0, size, size, part.patches):
                    last = offset
        return {"offset": last}

    def partitions(self, start, end):
        return byte_ranges(self.path, self.step, start["offset"], end["offset"])

    def read(self, partition):
        yield from read_range(partition, self.raw)


class MboxSource(DataSource):
    @classmethod
    def name(cls):
        return "mbox"

    def schema(self):
        return MESSAGE

    def reader(self, schema):
        return MboxReader(self.options)

    def streamReader(self, schema):
        return MboxTail(self.options)


def read_mbox(spark: SparkSession, paths: str | list[str], include_raw: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Messages of mailboxes in argument order: the message columns, mailbox, mailbox_ord and sequence (from 0 in each mailbox).

    ``raw`` is null unless asked for, so that a header scan reads no bodies. Files are split into byte ranges;
    a message belongs to the range in which its separator starts. An empty file gives no rows.
    """
    spark.dataSource.register(MboxSource)
    files = expand(paths)
    for p in files:
        file_size(p)
    rows = spark.read.format("mbox").option("paths", json.dumps(files)).option("rangeBytes", range_bytes).option("includeRaw", str(include_raw).lower()).load()
    ranges = max(1, sum(-(-file_size(p) // range_bytes) for p in files))
    order = F.array_position(F.array(*map(F.lit, files)), F.col("mailbox")) - 1
    if ranges == 1 or all(file_size(p) <= range_bytes for p in files):
        return rows.withColumns({"mailbox_ord": order, "sequence": F.col("ordinal")}).drop("part", "ordinal")
    # one row for each byte range: what stands before it in its mailbox
    counts = rows.groupBy("mailbox", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("mailbox").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(starts, "part").withColumns({"mailbox_ord": order, "sequence": F.col("before") + F.col("ordinal")}).drop("part", "ordinal", "before")


def fetch_raw(messages: DataFrame) -> DataFrame:
    """``messages`` with their raw bytes, read by mailbox, offset and length; each task reads in file order."""
    schema = messages.drop("raw").schema.add("raw", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                raws = []
                for p, offset, length in zip(*(part.column(c).to_pylist() for c in ("mailbox", "offset", "length")), strict=True):
                    if p != path:
                        path, f = p, open_file(p)
                    raws.append(message_at(f, offset, length))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raws, pa.binary())], [*part.schema.names, "raw"])

    ordered = messages.drop("raw").sortWithinPartitions("mailbox", "offset")
    return ordered.mapInArrow(run, schema)


def write_mbox(rows: DataFrame, path: str, order: list[str], record_col: str = "record") -> int:
    """Writes binary records in order into one local file and returns how many; the file appears when it is complete.

    Records are range-partitioned and streamed to the driver one partition at a time.
    """
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    n = 0
    try:
        with open(temporary, "wb") as out:
            for row in rows.orderBy(*order).select(record_col).toLocalIterator():
                out.write(row[0])
                n += 1
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)
    return n
