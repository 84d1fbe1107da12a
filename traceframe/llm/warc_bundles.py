"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames. Records are grouped into frames of about ``FRAME`` bytes (a larger record
is a frame of its own); a skippable frame at the end holds the seek table of the public seekable format: sizes of all frames
and a checksum of each. The index, a Parquet table, maps each record to its bundle, its frame and its place in the frame, so
one record is read by fetching the end of a file and one frame.

Of records with equal payloads, the one with the largest page_id holds the payload (``response``); the others refer to it
(``revisit``), so a payload that a third of all pages share is stored once. Payloads are brought together by one aggregation
that combines before its shuffle; pages that only refer to another one move without their text.

Tasks write bundles through ``pyarrow.fs`` under names of their own, below a folder that all executors share. Only the index,
which Spark commits, says which bundles count: what a lost or repeated task leaves is in no index and is removed at the end.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.common import cut_lineage, query, scratch_folder, table

#: Bytes of records that a frame takes before it is closed, and compressed bytes that a bundle takes.
FRAME, BUNDLE = 1 << 18, 1 << 26
#: Level of compression.
LEVEL = 3
# Fixed values of the seekable format: magic numbers of its skippable frame and of its footer, descriptor with checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_NO_ID = "none"


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """Store and path of a folder named as Spark names it."""
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


class BundleWriter:
    """Frames of one file; ``add`` gives the frame and the place that a record gets."""

    def __init__(self, store: pafs.FileSystem, path: str, frame: int = FRAME):
        self.path, self.frame, self.written = path, frame, 0
        self.sink = store.open_output_stream(path, compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.open: list[bytes] = []
        self.size = 0
        self.table: list[tuple[int, int, int]] = []

    def add(self, record: bytes) -> tuple[int, int]:
        if self.size and self.size + len(record) > self.frame:
            self._close_frame()
        at = len(self.table), self.size
        self.open.append(record)
        self.size += len(record)
        return at

    def _close_frame(self) -> None:
        raw = b"".join(self.open)
        packed = self.packer.compress(raw)
        self.sink.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.written += len(packed)
        self.open, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._close_frame()
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.sink.close()


class BundleReader:
    """Frames of one file by number; only the seek table and the frames asked for are read."""

    def __init__(self, store: pafs.FileSystem, path: str):
        self.source = store.open_input_file(path)
        end = self.source.size()
        n, _, magic = struct.unpack("<IBI", self.source.read_at(9, end - 9))
        table = self.source.read_at(12 * n + 17, end - 12 * n - 17)
        if magic != SEEKABLE or struct.unpack_from("<II", table) != (SKIPPABLE, 12 * n + 9):
            raise ValueError(f"no seek table at the end of {path}")
        self.table = list(struct.iter_unpack("<III", table[8 : 8 + 12 * n]))
        self.starts = [0]
        for packed, _, _ in self.table:
            self.starts.append(self.starts[-1] + packed)
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        packed, size, check = self.table[number]
        raw = self.unpacker.decompress(self.source.read_at(packed, self.starts[number]), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {number} is damaged")
        return raw

    def close(self) -> None:
        self.source.close()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: int | None, copy: int) -> str:
    return f"urn:x-page:{_NO_ID if page_id is None else page_id}:{copy}"


def make_record(page_id: int | None, copy: int, url: str | None, payload: bytes | None, size: int, digest: str, to: int | None, date: str) -> bytes:
    """A response record, or with payload None a revisit of the record of page ``to``; both state the payload's full size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    urn = record_urn(page_id, copy)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <{urn}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~-._' + chr(39)) if url else urn}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if payload is None:
        head += [f"WARC-Refers-To: <{record_urn(to, 0)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes, at: int) -> tuple[dict[str, str], int]:
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}, end + 4


def parse_record(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at ``at``, and where the next one begins. The digest of a payload that is there is verified."""
    if not raw.startswith(b"WARC/1.", at):
        raise ValueError(f"no record at {at}")
    warc, block = _headers(raw, at)
    end = block + int(warc["content-length"])
    made = {"record_type": warc["warc-type"], "record_id": warc["warc-record-id"][1:-1], "url": warc.get("warc-target-uri"), "payload": None, "refers_to": None}
    if warc["warc-type"] in ("response", "revisit"):
        http, body = _headers(raw, block)
        made |= {"payload_bytes": int(http["content-length"]), "payload_digest": warc["warc-payload-digest"].removeprefix("sha1:")}
        if warc["warc-type"] == "response":
            made["payload"] = raw[body:end]
            if len(made["payload"]) != made["payload_bytes"] or payload_digest(made["payload"]) != made["payload_digest"]:
                raise ValueError(f"payload of {made['record_id']} is damaged")
        else:
            made["refers_to"] = _page(warc["warc-refers-to"][1:-1])
    return made, end + 4


def _page(urn: str) -> int | None:
    page = urn.split(":")[2]
    return None if page == _NO_ID else int(page)


def _records(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, copy, url, html, size, to): html is null in a revisit. Equal payloads are told by SHA-1, a second hash and size."""
    heads = pages.withColumn("size", F.octet_length("html").cast("bigint")).withColumn("sha", F.sha1("html")).withColumn("other", F.xxhash64("html"))
    shared = heads.where(F.col("size") >= least_bytes)
    key = ["sha", "other", "size"]
    # one row a payload: its text once, whoever holds it
    holder = F.max(F.struct(F.col("page_id").isNotNull(), "page_id", "url"))
    held = shared.groupBy(*key).agg(holder.alias("top"), F.any_value("html").alias("html"), F.count("*").alias("n"))
    response = held.select("top.page_id", F.lit(0).cast("bigint").alias("copy"), "top.url", "html", "size", F.lit(None).cast("bigint").alias("to"))
    # everything else refers to it, without its text; rows that repeat a page count one by one
    rest = shared.groupBy(*key, "page_id", "url").agg(F.count("*").alias("copies"))
    several = shared.groupBy(*key).agg(holder.alias("top"), F.count("*").alias("n")).where("n > 1").select(*key, F.col("top.page_id").alias("to"), F.col("top.url").alias("to_url"))
    own = (F.col("page_id").eqNullSafe(F.col("to")) & F.col("url").eqNullSafe(F.col("to_url"))).cast("bigint")
    revisits = rest.join(several, key).withColumn("copies", F.col("copies") - own).where("copies > 0")
    revisit = revisits.select("page_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"), "url", F.lit(None).cast("string").alias("html"), "size", "to", "sha")
    records = response.withColumn("sha", F.lit(None).cast("string")).union(revisit)
    if least_bytes > 0:
        small = heads.where(F.col("size") < least_bytes)
        records = records.union(small.select("page_id", F.lit(0).cast("bigint"), "url", "html", "size", F.lit(None).cast("bigint"), F.lit(None).cast("string")))
    return records


def write_bundles(pages: DataFrame, folder: str, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z", frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Write one record for each page below ``folder`` and return the index, read back from ``folder/index``.

    Index: record_id, page_id, record_type, bundle, frame, offset, length. A null html is an empty payload. Payloads of at
    least ``least_bytes`` bytes are stored once: the largest page_id is the response (an id is larger than none; of rows
    that repeat it, one), all others are revisits. Shorter ones are all responses. Pages have no date, so all records
    state ``date``. A record without url names itself. Empty tables give an empty index. Other columns are not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        store.create_dir(path)
        writer = None
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                payload = None if r["html"] is None else r["html"].encode()
                digest = payload_digest(payload) if payload is not None else base64.b32encode(bytes.fromhex(r["sha"])).decode()
                record = make_record(r["page_id"], r["copy"], r["url"], payload, r["size"], digest, r["to"], date)
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(store, f"{path}/{name}", frame)
                    writer.add(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.UUID(hex=name[:32])}>\r\nWARC-Date: {date}\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode())
                number, at = writer.add(record)
                rows.append((record_urn(r["page_id"], r["copy"]), r["page_id"], "revisit" if payload is None else "response", name, number, at, len(record)))
                if writer.written + writer.size >= bundle:
                    writer.close()
                    writer = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["record_id", "page_id", "record_type", "bundle", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    given = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    index = _records(given, least_bytes).mapInArrow(write, "record_id string, page_id bigint, record_type string, bundle string, frame int, offset bigint, length bigint")
    index.write.parquet(f"{folder}/index")
    return open_index(pages.sparkSession, folder)


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the bundles in a folder."""
    return spark.read.schema("record_id string, page_id bigint, record_type string, bundle string, frame int, offset bigint, length bigint").parquet(f"{folder}/index")


def remove_orphans(spark: SparkSession, folder: str) -> int:
    """Delete bundles that no index row names (left by tasks that ran again); how many there were."""
    store, path = filesystem(folder)
    there = [(x.path,) for x in store.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".warc.zst")] if store.get_file_info(path).type != pafs.FileType.NotFound else []
    if not there:
        return 0
    named = open_index(spark, folder).select("bundle").distinct()
    found = spark.createDataFrame(there, "path string").withColumn("bundle", F.element_at(F.split("path", "/"), -1))
    gone = 0
    for r in found.join(named, "bundle", "left_anti").toLocalIterator():
        store.delete_file(r["path"])
        gone += 1
    return gone


_OUT = "record_id string, page_id bigint, record_type string, url string, payload_bytes bigint, payload_digest string, refers_to bigint, payload string"
_TYPES = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())


def _row(made: dict, payloads: bool) -> tuple:
    payload = made["payload"].decode() if payloads and made["payload"] is not None else None
    return made["record_id"], _page(made["record_id"]), made["record_type"], made["url"], made["payload_bytes"], made["payload_digest"], made["refers_to"], payload


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, _TYPES)], names=[x.split(" ")[0] for x in _OUT.split(", ")])


def read_bundles(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the indexed bundles, frame by frame; payloads are verified, and returned if asked for.

    record_id, page_id, record_type, url, payload_bytes, payload_digest, refers_to, payload (null in a revisit).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                reader = BundleReader(store, f"{path}/{name}")
                for number in range(len(reader.table)):
                    raw, at, rows = reader.frame(number), 0, []
                    while at < len(raw):
                        made, at = parse_record(raw, at)
                        if made["record_type"] != "warcinfo":
                            rows.append(_row(made, payloads))
                    yield _batch(rows)
                reader.close()

    # bundles are few rows of much work: dealt evenly to a fixed number of partitions, which no size estimate merges
    partitions = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return open_index(spark, folder).select("bundle").distinct().repartition(partitions).mapInArrow(read, _OUT)


def fetch(spark: SparkSession, folder: str, wanted: DataFrame, page_id: str = "page_id") -> DataFrame:
    """The records of the wanted pages, payloads of revisits included: only frames that hold one of them are read.

    wanted: a DataFrame with page ids; repeated and null ids count once and not at all. Pages without record give no row.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        name, number, reader, raw = None, None, None, b""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["bundle"] != name:
                    if reader:
                        reader.close()
                    name, number, reader = r["bundle"], None, BundleReader(store, f"{path}/{r['bundle']}")
                if r["frame"] != number:
                    number, raw = r["frame"], reader.frame(r["frame"])
                rows.append(_row(parse_record(raw, r["offset"])[0], True))
            yield _batch(rows)
        if reader:
            reader.close()

    def records(ids: DataFrame, index: DataFrame) -> DataFrame:
        at = index.join(ids, "page_id").select("bundle", "frame", "offset")
        return at.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(read, _OUT)

    index = open_index(spark, folder)
    ids = wanted.select(F.col(page_id).cast("bigint").alias("page_id")).where("page_id is not null").distinct()
    own = cut_lineage(records(ids, index))
    targets = own.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id")).where("page_id is not null").distinct()
    held = records(targets, index.where("record_type = 'response'")).select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload").alias("_held"))
    return own.join(held, ["refers_to", "payload_digest"], "left").withColumn("payload", F.coalesce("payload", "_held")).select(*own.columns)


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@query(
    "op11_warc_bundles",
    f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p),
    fives AS (SELECT *, [CAST('0x' || substr(x, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) FOR i IN range(8)] AS five FROM d)
    SELECT page_id, payload_bytes,
        array_to_string([array_to_string([substr('{_BASE32}', 1 + ((v >> s) & 31), 1) FOR s IN [15, 10, 5, 0]], '') FOR v IN five], '') AS payload_digest,
        CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
    FROM fives
    """,
)
def op11_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    write_bundles(table(spark, sf_dir, "pages"), folder)
    return read_bundles(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
