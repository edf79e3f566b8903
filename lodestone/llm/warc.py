"""WARC archives: a deterministic sharded writer, and a reader.

Records are dealt to shards by key ranges whose bounds come from a hash sample of the keys, so that they depend on the rows
alone; a task takes a range of shards, whose records are sorted and written as gzip members, into a new file whenever the compressed size reaches roll_bytes.
Headers and digests are made anew from the payload. A task writes under a name of its own and renames a finished file, so a
task that runs twice leaves the same files; a dataset of their names, sizes and checksums (the manifest) is written
last, and a reader takes the files that it lists and no others. Of equal payloads of at least min_bytes, the one with the
largest page_id is kept as a response; the others are revisits that name it.

Tasks write and read by pyarrow's file systems, so the folder may be local to a test or any store that these know.

A record's id names its page, its payload and how many records with both came before it, so that rows that repeat have ids of their own.

Defined results: a null html is an empty payload; a null url is an empty target; a null page_id makes a record without one
that is a revisit if its payload has a page_id elsewhere, else a response; rows that repeat the largest page_id with an
equal payload are all responses; an empty table gives an empty manifest and no records; other columns are not looked at; a payload of any size is one record.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, fresh_path

MIN_BYTES = 0
#: At least so many shards, and more where they would pass shard_bytes of payload.
SHARDS = 64
SHARD_BYTES = 256 << 20
ROLL_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes at which a record's member is passed on to the file, and read from it.
PIECE = 1 << 20

MANIFEST = "name string, shard int, n_records long, n_bytes long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _id(page_id: int | None, value: str, before: int) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{value}:{before}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, before: int = 0) -> bytes:
    """The bytes of a WARC/1.1 record; of a revisit where refers_to is given. before: records of this page and payload written so far."""
    target, value = quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"), digest(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page_id, value, before)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: {_id(refers_to, value, 0)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{value}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _File:
    """One archive on its way: under a temporary name until it is closed."""

    def __init__(self, root: str, shard: int, number: int) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(root)
        self.name, self.shard = f"part-{shard:06d}-{number:05d}.warc.gz", shard
        self.temporary = f"{self.folder}/_temporary/{self.name}.{uuid.uuid4().hex}"
        self.store.create_dir(f"{self.folder}/_temporary", recursive=True)
        self.out, self.size, self.records, self.sum = self.store.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        self.store.move(self.temporary, f"{self.folder}/{self.name}")
        return self.name, self.shard, self.records, self.size, self.sum.hexdigest()


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, _payload and _refers, the page_id of the response where a row is a revisit."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("_payload")).withColumns({"_sha": F.sha1("_payload"), "_n": F.length("_payload")})
    # Different payloads with one SHA-1 are known; equal ones agree in two digests and the length.
    df = df.withColumn("_second", F.substring(F.unhex(F.sha2("_payload", 256)), 1, 16))
    same = df.filter(F.col("_n") >= min_bytes).groupBy(F.col("_sha").alias("_s"), F.col("_n").alias("_m"), F.col("_second").alias("_s2")).agg(F.max("page_id").alias("_first"), F.count("*").alias("_copies"))
    same = cut(same.filter("_copies > 1").drop("_copies"), "warc-copies")
    df = df.join(same, (F.col("_sha") == F.col("_s")) & (F.col("_n") == F.col("_m")) & (F.col("_second") == F.col("_s2")), "left")
    return df.withColumn("_refers", F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))).select("page_id", "url", "_payload", "_sha", "_n", "_refers")


def shard_bounds(keys: DataFrame, shards: int, shard_bytes: int, sample: int = 20_000) -> list[tuple[int, str]]:
    """Lower bounds (_key, _sha) of all shards but the first, from keys (_key, _sha, _n).

    The sample is the distinct keys whose hash falls under a share that leaves about sample rows at most, whichever task reads them.
    """
    total = keys.agg(F.count("*").alias("rows"), F.sum("_n").alias("bytes")).first()
    shards = max(shards, -(-(total["bytes"] or 0) // shard_bytes))
    every = max(1, total["rows"] // sample)
    picked = keys.filter(F.pmod(F.xxhash64("_key", "_sha"), F.lit(every)) == 0).select("_key", "_sha").distinct().collect()
    found = sorted((x["_key"], x["_sha"]) for x in picked)
    return sorted({found[len(found) * i // shards] for i in range(1, shards)}) if found else []


def write_archives(pages: DataFrame, root: str, min_bytes: int = MIN_BYTES, shards: int = SHARDS, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives under root and return the manifest, which is written last."""
    # A null page_id sorts first, by a key of its own.
    df = revisits(pages, min_bytes).withColumn("_key", F.coalesce("page_id", F.lit(-(2**63))))
    bounds = shard_bounds(df.select("_key", "_sha", "_n"), shards, shard_bytes)

    shard_of = F.pandas_udf(lambda k, s: pd.Series([bisect.bisect_right(bounds, x) for x in zip(k, s, strict=True)], dtype="int32"), "int")
    df = df.withColumn("_shard", shard_of("_key", "_sha")).repartitionByRange(max(1, len(bounds) + 1), "_shard").sortWithinPartitions("_shard", "_key", "_sha", "url")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, shard, number, done, last, before = None, None, 0, [], None, 0
        for pdf in batches:
            for of, page_id, sha, known, url, payload, refers, referring in zip(pdf["_shard"], pdf["_key"], pdf["_sha"], pdf["_known"], pdf["url"], pdf["_payload"], pdf["_to"], pdf["_revisit"], strict=True):
                last, before = (page_id, sha), before + 1 if last == (page_id, sha) else 0
                if file and (of != shard or file.size >= roll_bytes):
                    done.append(file.close())
                    number, file = (number + 1 if of == shard else 0), None
                if file is None:
                    shard = of
                    file = _File(root, int(of), number)
                file.write(_member(record(int(page_id) if known else None, url, bytes(payload), int(refers) if referring else None, before)))
        if file:
            done.append(file.close())
        yield pd.DataFrame(done, columns=["name", "shard", "n_records", "n_bytes", "sha256"])

    rows = df.select("_shard", "_key", "_sha", F.col("page_id").isNotNull().alias("_known"), "url", "_payload", F.coalesce("_refers", F.lit(0)).alias("_to"), F.col("_refers").isNotNull().alias("_revisit"))
    rows.mapInPandas(write, MANIFEST).write.parquet(f"{root}/_manifest")
    store, folder = fs.FileSystem.from_uri(root)
    if store.get_file_info(f"{folder}/_temporary").type != fs.FileType.NotFound:  # what tasks that failed have left
        store.delete_dir(f"{folder}/_temporary")
    return df.sparkSession.read.schema(MANIFEST).parquet(f"{root}/_manifest")


def _members(stream) -> Iterator[bytes]:  # noqa: ANN001
    """The records of an archive, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    while data := stream.read(PIECE):
        while data:
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])


def _page(value: str) -> int | None:
    found = value.removeprefix("<urn:x-page:").partition(":")[0]
    return None if found == "none" else int(found)


def parse(data: bytes) -> tuple:
    """The fields of RECORD; a ValueError if a digest or a length is wrong."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = block[: int(fields["Content-Length"])]
    if f"sha1:{digest(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size, value, kind = int(_fields(http)["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != value):
        raise ValueError(f"payload of {fields['WARC-Record-ID']}")
    return _page(fields["WARC-Record-ID"]), size, value, kind, _page(fields["WARC-Refers-To"]) if kind == "revisit" else None, fields["WARC-Target-URI"], payload if kind == "response" else None


def read_archives(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """The records of all files that the manifest lists (RECORD), payload null for revisits, or for all without payloads."""
    files = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest").select("name")
    n = files.count()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = fs.FileSystem.from_uri(root)
        columns = [x.split()[0] for x in RECORD.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
        for pdf in batches:
            for name in pdf["name"]:
                rows, size = [], 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for data in _members(stream):
                        row = parse(data)
                        rows.append(row if payloads else (*row[:-1], None))
                        size += len(data)
                        if size >= 8 * PIECE:
                            yield frame(rows)
                            rows, size = [], 0
                yield frame(rows)

    return files.repartition(max(1, n), "name").mapInPandas(read, RECORD)


def archive(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write pages to a fresh folder of archives and read it back."""
    root = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, root, min_bytes)
    return read_archives(pages.sparkSession, root, payloads=False)
