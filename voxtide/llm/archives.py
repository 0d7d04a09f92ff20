"""WARC archives with a Zstandard dictionary: written by tasks, records compressed one by one, and read back.

The library has no web records of its own, so this operator is general: a record has an id, a URI and a payload.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.session import shared_dir

# Fixed values of the format: the skippable frame that holds the dictionary, and the profile of identical payloads.
DICTIONARY_FRAME = 0x184D2A5D
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Bytes of records after which a task begins another archive, and records that the dictionary is built from.
ARCHIVE_BYTES = 64 << 20
DICTIONARY_RECORDS, DICTIONARY_BYTES, SAMPLE_CHARS = 512, 64 << 10, 16_384


def train_dictionary(payloads: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary of a quarter of the payloads at most, or nothing where they are too few to build one."""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, payloads)) // 4), payloads).as_bytes() if len(payloads) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def sampled_payloads(records: DataFrame, count: int = DICTIONARY_RECORDS) -> list[bytes]:
    """Beginnings of the payloads of the ``count`` ids with the smallest hash, at most ``SAMPLE_CHARS`` of each: a bounded
    sample, from which the dictionary is built and nothing else. Only ids are ordered."""
    known = records.filter("record_id IS NOT NULL AND payload <> ''")
    chosen = known.select("record_id").distinct().orderBy(F.xxhash64("record_id"), "record_id").limit(count).collect()
    start = known.filter(F.col("record_id").isin([row.record_id for row in chosen])).select("record_id", F.substring("payload", 1, SAMPLE_CHARS).alias("p"))
    return [row.p.encode() for row in start.groupBy("record_id").agg(F.max("p").alias("p")).orderBy("record_id").collect()]


def typed_records(records: DataFrame, min_bytes: int) -> DataFrame:
    """Adds ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``.

    Of equal payloads of at least ``min_bytes`` that with the largest ``record_id`` is the response. Only digests
    are grouped, with partial maxima; the join that brings the maximum back can be split where one payload is very common.
    """
    rows = records.withColumn("_raw", F.coalesce("payload", F.lit("")).cast("binary"))
    rows = rows.withColumn("payload_bytes", F.octet_length("_raw").cast("bigint")).withColumn("payload_digest", F.sha1("_raw")).drop("_raw")
    # Equal payloads by a stronger hash than the digest of the format.
    rows = rows.withColumn("_same", F.when(F.col("payload_bytes") >= min_bytes, F.sha2(F.coalesce("payload", F.lit("")), 256)))
    first = rows.filter("_same IS NOT NULL").groupBy("_same").agg(F.max("record_id").alias("_of"))
    # A page alone with its payload needs no entry, which most do not.
    joined = rows.join(first, "_same", "left")
    revisit = F.col("_of").isNotNull() & (F.col("record_id") < F.col("_of"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(revisit, F.col("_of"))
    ).drop("_same", "_of")


def _head(fields: list[tuple[str, str]], length: int) -> bytes:
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}", "", ""]).encode()


def record_bytes(record: dict) -> bytes:
    """One WARC record. A revisit has no block: its payload is the one that it refers to."""
    block = (record["payload"] or "").encode() if record["record_type"] == "response" else b""
    uri = "".join(c for c in record["uri"] or "" if c > " ") or "urn:unknown"
    fields = [
        ("WARC-Type", record["record_type"]),
        ("WARC-Record-ID", f"<urn:record:{record['record_id']}>"),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{record['payload_digest']}"),
        ("WARC-Payload-Length", str(record["payload_bytes"])),
    ]
    if record["record_type"] == "revisit":
        fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<urn:record:{record['refers_to']}>")]
    return _head(fields, len(block)) + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, min_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``record_id, uri, payload`` as archives under ``folder``: one row ``path, records, bytes`` for each file.

    ``folder`` is a URI that driver and executors share. An archive begins with the dictionary in a skippable frame;
    each record is a Zstandard frame of its own, so any of them can be read by offset. Tasks write archives of about
    ``archive_bytes`` under names of their own; only files in the result count, so what a lost or repeated task left
    is not read. The result is a table under ``folder``, written once.

    A null payload is empty, a null or blank URI is ``urn:unknown``; a null id is written as such and is no one's
    response. Rows that share an id and payload are all responses. Further columns are ignored; an empty table
    writes no archive.
    """
    rows = records.select(F.col("record_id").cast("bigint").alias("record_id"), F.col("uri").cast("string").alias("uri"), F.col("payload").cast("string").alias("payload"))
    dictionary = train_dictionary(sampled_payloads(rows))
    typed = typed_records(rows, min_bytes)
    names = typed.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = pafs.FileSystem.from_uri(folder)
        store.create_dir(f"{place}/archives", recursive=True)
        made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=made, write_checksum=True)
        out, path, count, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]})

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for row in batch.slice(at, 200).to_pylist():
                    if out is None:
                        path = f"archives/{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.zst"
                        out, count, size = store.open_output_stream(f"{place}/{path}", compression=None), 0, 0
                        if dictionary:
                            out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                    frame = packer.compress(record_bytes(dict(zip(names, row.values()))))
                    out.write(frame)
                    count, size = count + 1, size + len(frame)
                    if size >= archive_bytes:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    listed = typed.mapInArrow(write, "path string, records bigint, bytes bigint")
    listed.write.parquet(f"{folder}/archive_list")
    return records.sparkSession.read.parquet(f"{folder}/archive_list")


def frames(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one by one, with the dictionary of its leading frame."""
    at, made, step = 0, None, 8192
    if archive[:4] == struct.pack("<I", DICTIONARY_FRAME):
        at = 8 + struct.unpack_from("<I", archive, 4)[0]
        made = zstandard.ZstdCompressionDict(archive[8:at])
    data, opener = memoryview(archive), zstandard.ZstdDecompressor(dict_data=made) if made else zstandard.ZstdDecompressor()
    while at < len(archive):
        reader, parts = opener.decompressobj(), []
        while not reader.eof:
            if at >= len(archive):
                raise ValueError("the archive ends inside a record")
            parts.append(reader.decompress(data[at : at + step]))
            at = min(at + step, len(archive))
        at -= len(reader.unused_data)
        yield b"".join(parts)


def parsed_record(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("broken record")
    number = lambda v: int(v[12:-1]) if v and v[12:-1] != "None" else None
    response = fields["WARC-Type"] == "response"
    digest = hashlib.sha1(block).hexdigest() if response else fields["WARC-Payload-Digest"][5:]
    if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
        raise ValueError("the payload does not have its digest")
    return {
        "record_id": number(fields["WARC-Record-ID"]),
        "uri": fields["WARC-Target-URI"],
        "payload": block.decode() if response else None,
        "payload_bytes": len(block) if response else int(fields["WARC-Payload-Length"]),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To", "")),
    }


READ_SCHEMA = "record_id bigint, uri string, payload string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the listed archives: ``record_id, uri, payload`` (null for revisits), ``payload_bytes,
    payload_digest, record_type, refers_to``. A record that is cut short or has another digest is an error."""
    listed = spark.read.parquet(f"{folder}/archive_list")
    schema = pa.schema(
        [("record_id", pa.int64()), ("uri", pa.string()), ("payload", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{place}/{path}", compression=None) as file:
                    archive = file.read()
                rows = []
                for record in frames(archive):
                    rows.append(parsed_record(record))
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    # One archive is one piece of work, however many a row group of the list has.
    return listed.select("path").repartition(max(1, listed.count())).mapInArrow(read, READ_SCHEMA)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the folder that the cluster shares."""
    shared = shared_dir(spark)
    return f"{shared if ':/' in shared else 'file://' + shared}/archives-{uuid.uuid4().hex}"
