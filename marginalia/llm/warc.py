"""WARC archives: a deterministic sharded writer and a reader.

Writing: records are sorted by range of their id, each range goes to a numbered shard, and a shard's
file is closed once its compressed size reaches the limit. All headers, record ids, digests and
lengths are made anew from the payloads, with one date for the whole archive, so that the same rows
and ranges give the same bytes. A file is written under a temporary name, moved to its final name when
complete, and counts only when the manifest lists it: a task that is lost or run twice leaves at most
temporary files, or replaces a file by itself.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import shared_dir, slices, written

_ID, _URL, _HTML = "page_id", "url", "html"
_LEAST_ID = -(1 << 63)  # stands for a null id where ids are compared
_NO_ID = "null"
SHARD_BYTES = 128 << 20  # of payload in a shard, about, if the number of shards is not given
FILE_BYTES = 16 << 20  # compressed, from which a shard goes on in a new file
_SPACE = uuid.UUID("7e0c0d7c-4f0b-5d54-8d5a-3f0f6f1b6c11")  # record ids are named in this space

MANIFEST = "file string, shard int, records bigint, bytes bigint, sha256 string, first_id bigint, last_id bigint"


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder, which may be any that pyarrow knows."""
    return pyarrow.fs.FileSystem.from_uri(uri)


def repeats(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(pid, digest, first) for each record whose payload of at least ``least_bytes`` bytes occurs
    more than once; first is the smallest id with it. Only ids and digests are shuffled, partly
    counted before; a payload that a third of all records share is one row of the counts, and
    adaptive execution splits its ids in the join."""
    lean = pages.where(F.octet_length("payload") >= least_bytes).select("pid", F.sha2("payload", 256).alias("digest"))
    counted = lean.groupBy("digest").agg(F.min("pid").alias("first"), F.count("*").alias("n")).where("n > 1")
    return lean.join(counted.select("digest", "first"), "digest").distinct()


def _name(page_id: int | None) -> str:
    return _NO_ID if page_id is None or page_id == _LEAST_ID else str(page_id)


def _record_id(kind: str, page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {_name(page_id)} {digest} {copy}')}>"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, copy: int = 0) -> bytes:
    """One WARC/1.1 record, the ``copy``-th of its id and payload. A revisit has no payload; its headers
    tell the digest and length of the full one, and the record that holds it."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(kind, page_id, digest, copy)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {_name(page_id)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    body = payload
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {_name(refers_to)}", f"WARC-Refers-To: {_record_id('response', refers_to, digest, 0)}"]
        body = b""
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    """A gzip member without time or name, so that equal records give equal bytes."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


class _Shard:
    """The open file of a shard, and rows of the manifest for those that are complete."""

    def __init__(self, folder: str, shard: int, limit: int):
        self.store, self.root = open_store(folder)
        self.shard, self.limit, self.number = shard, limit, 0
        self.out = None
        self.done: list[tuple] = []

    def add(self, data: bytes, page_id: int | None) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.sha, self.size, self.records, self.first = self.store.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0, page_id
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.records += 1
        self.last = page_id
        if self.size >= self.limit:
            self.close()

    def close(self) -> list[tuple]:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temporary, f"{self.root}/{self.name}")
            self.done.append((self.name, self.shard, self.records, self.size, self.sha.hexdigest(), self.first, self.last))
            self.out = None
            self.number += 1
        return self.done


def _starts(pid: np.ndarray, lows: np.ndarray, highs: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first id of the step that each id is in, of ranges from ``lows`` to ``highs`` (sorted, apart) that are
    cut into steps, and whether a range has it. Differences are taken without sign, as they may not
    fit a long."""
    at = np.searchsorted(lows, pid, side="right") - 1
    inside = (at >= 0) & (pid <= highs[at])
    low, step = lows[at].view(np.uint64), steps[at]
    own = pid.view(np.uint64)
    return (low + (own - low) // step * step).view(np.int64), inside


def edges(sizes: DataFrame, shards: int, width: int = 4096) -> np.ndarray:
    """Ids at which shards 1, 2, ... begin, so that each holds about as much of the rows' (pid, size). They follow from the rows alone, not from samples or partitions: bytes are summed in ranges of equal width, and
    a range with more than a shard's share is cut again. The driver gets sums of ranges, ``width`` at first
    and as many for each range that is cut, of which there are fewer than shards; tasks get the ranges as arrays."""
    low, high, total = sizes.agg(F.min("pid"), F.max("pid"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if shards < 2 or not total or low == high:
        return np.zeros(0, dtype=np.int64)
    counted: dict[int, int] = {}
    open_ranges = [(low, high)]
    while open_ranges:
        open_ranges.sort()
        cuts = [max(1, -(-(b - a + 1) // width)) for a, b in open_ranges]
        listed = [np.array([a for a, _ in open_ranges], dtype=np.int64), np.array([b for _, b in open_ranges], dtype=np.int64), np.array(cuts, dtype=np.uint64)]
        held = sizes.sparkSession.sparkContext.broadcast(listed)  # fewer ranges than shards

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pid, weights = (c.to_numpy() for c in batch.columns)
                start, inside = _starts(pid, *held.value)
                first, at = np.unique(start[inside], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(np.bincount(at, weights[inside], len(first)).astype(np.int64))], names=["start", "n"])

        rows = sizes.select("pid", "size").mapInArrow(run, "start bigint, n bigint").groupBy("start").agg(F.sum("n").alias("n")).collect()
        lows, further = listed[0].tolist(), []
        for r in rows:
            k = bisect.bisect_right(lows, r.start) - 1
            if r.n * shards > total and cuts[k] > 1:
                further.append((r.start, min(r.start + cuts[k] - 1, open_ranges[k][1])))
            else:
                counted[r.start] = r.n
        open_ranges = further
    found, seen = [], 0
    for start in sorted(counted):
        if seen * shards >= total * (len(found) + 1):
            found.append(start)
        seen += counted[start]
    return np.array(found, dtype=np.int64)


def place(spark: SparkSession, starts: np.ndarray):
    """A function of ids: how many of the sorted ``starts`` are at or before each. Tasks get them as an array."""
    held = spark.sparkContext.broadcast(starts)  # a number a shard

    @F.pandas_udf("int")
    def shard(pid: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, pid.to_numpy(), side="right").astype(np.int32))

    return shard


def write(pages: DataFrame, folder: str, least_bytes: int = 100, file_bytes: int = FILE_BYTES, shards: int | None = None, date: str = "2000-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Writes ``pages`` (page_id, url, html; other columns are not kept) to ``folder`` and returns the
    manifest, which is written there as Parquet too.

    Of records with equal payloads of ``least_bytes`` or more, the one with the smallest page_id is a
    response, the others are revisits of it; smaller payloads are all responses. Nulls: a null html is
    an empty payload, a null url an empty one, and a null page_id comes before all others. Of rows
    that repeat an id with the same payload one counts as first and the rest revisit that id. An
    empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    store, root = open_store(folder)
    store.create_dir(f"{root}/_temporary", recursive=True)
    base = pages.select(_ID, _URL, F.coalesce(_HTML, F.lit("")).alias("payload"), F.coalesce(_ID, F.lit(_LEAST_ID)).alias("pid"))
    # what a revisit refers to travels as a row of its own and sorts right before it, so that payloads
    # are shuffled once
    again = written(repeats(base, least_bytes).where("pid != first"), "revisits")
    full = base.select(_ID, _URL, "payload", "pid", F.sha2("payload", 256).alias("digest"), F.lit(None).cast("long").alias("first"), F.lit(True).alias("page"))
    told = again.select(F.lit(None).cast("long").alias(_ID), F.lit(None).cast("string").alias(_URL), F.lit(None).cast("string").alias("payload"), "pid", "digest", "first", F.lit(False).alias("page"))
    sizes = written(base.select("pid", (F.octet_length("payload") + 1).cast("long").alias("size")), "sizes")
    if shards is None:
        payload = sizes.agg(F.sum("size")).first()[0] or 0
        shards = -(-payload // SHARD_BYTES)  # by the payload alone, so that any session writes the same files
    n = max(1, shards)
    placed = full.union(told).withColumn("shard", place(spark, edges(sizes, n))("pid"))
    ordered = placed.repartitionById(n, "shard").sortWithinPartitions("shard", "pid", "digest", "page", _URL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, done = None, []
        before, refers, copy = None, None, 0
        for batch in slices(batches):
            for row in batch.to_pylist():
                own, same = (row["pid"], row["digest"]), (row["pid"], row["digest"]) == before
                before = own
                if not row["page"]:
                    refers, copy = row["first"], 0
                    continue
                payload = row["payload"].encode("utf-8", "surrogatepass")
                if not same:
                    refers, copy = None, 0
                if shard is None or shard.shard != row["shard"]:
                    done += shard.close() if shard else []
                    shard = _Shard(folder, row["shard"], file_bytes)
                kind = "response" if refers is None else "revisit"
                shard.add(_member(record(kind, row[_ID], row[_URL], payload, row["digest"], refers, date, copy), level), row[_ID])
                copy += 1
                if refers is None and len(payload) >= least_bytes:
                    refers = row["pid"]  # of rows that follow with the same id and payload
        done += shard.close() if shard else []
        columns = list(zip(*done)) or [()] * 7
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    path = f"{folder}/_manifest"
    ordered.mapInArrow(run, MANIFEST).write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


def records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of a file of gzip members, one at a time."""
    unpack, held, data = zlib.decompressobj(31), [], b""
    while True:
        if not data and not (data := stream.read(1 << 20)):
            if any(held):
                raise ValueError("the file ends inside a record")
            return
        held.append(unpack.decompress(data))
        data = b""
        if unpack.eof:
            data, whole = unpack.unused_data, b"".join(held)
            head, _, rest = whole.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
            size = int(fields["content-length"])
            if first != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
                raise ValueError("not a WARC record")
            yield fields, rest[:size]
            unpack, held = zlib.decompressobj(31), []


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the archive in ``folder``: page_id, url, payload_bytes and payload_digest (of
    the full payload), record_type, refers_to, file (and payload, null for revisits, if asked for).
    Files that the manifest does not list are not read; payloads are held against their digests."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("file")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string" + ", payload binary" * with_payload

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for fields, payload in records(stream):
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        revisit = fields["warc-type"] == "revisit"
                        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload does not have its digest")
                        page = fields["x-page-id"]
                        to = fields.get("x-refers-to-page")
                        to = None if to in (None, _NO_ID) else int(to)
                        rows.append((None if page == _NO_ID else int(page), fields["warc-target-uri"], int(fields["x-payload-length"]), digest, fields["warc-type"], to, name, None if revisit else payload)[: len(names)])
                        held += len(payload) if with_payload else 0
                        if len(rows) >= 4096 or held > 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = manifest.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    return files.mapInArrow(run, schema)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` to a new folder of the shared storage and reads the archive back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, **options)
    return read(pages.sparkSession, folder)
