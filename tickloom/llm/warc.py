"""WARC archives with a two-level capture index.

Archives hold one gzip member per record. The index is sorted by reversed-host keys: each range
of keys is a shard file of compressed blocks with a sparse directory beside it (first key and
place of each block). A look-up finds the shard, then the block by binary search in the directory,
and reads only that block's bytes, and only the record's bytes from the archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.llm.common import with_row_key
from tickloom.llm.langid import host_of
from tickloom.session import shared_root, stage

#: Index lines of a block, bytes at which an archive is closed, and the least payload that is not written twice.
BLOCK_LINES, ARCHIVE_BYTES, MIN_REVISIT_BYTES = 1000, 256 << 20, 0
#: Bytes of neighbouring records that are read at once, and of a stretch of an archive that one task reads.
READ_BYTES, STRETCH_BYTES = 8 << 20, 32 << 20
_DATE = "2024-01-01T00:00:00Z"


def surt(url: Column) -> Column:
    """Sort key of an address: host labels from the right, then path and query; no scheme, port or fragment."""
    host = host_of(url)
    rest = F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*([^#]*)", 1)
    path = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)
    return F.when(host.isNull(), F.concat(F.lit("-)"), F.coalesce(url, F.lit("")))).otherwise(key)


def archive_root(spark: SparkSession) -> str:
    """A new folder in the shared area, beside the staged tables."""
    return f"{shared_root(spark)}/staged/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root else "file://" + root if root.startswith("/") else root)


def record_bytes(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit (``payload`` None) without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + json.dumps(url)[1:-1])  # no line breaks in a header
    if payload is None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{'none' if refers_to is None else refers_to}>")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parse_record(member: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """(page_id, payload bytes, digest, type, refers_to, payload) of a gzip member, as its headers say."""
    head, _, block = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    page = lambda v: None if v is None or v == "<urn:page:none>" else int(v[10:-1])
    return page(fields["WARC-Record-ID"]), size, fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], page(fields.get("WARC-Refers-To")), payload


def write_archives(pages: DataFrame, root: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes ``pages`` (``page_id``, ``url``, ``html``) under ``root``; returns the captures, stored.

    Captures: ``key``, ``page_id``, ``file``, ``offset``, ``length``. Files have new names in every
    attempt of a task, and only those of the attempt that counts are among the captures.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed, keys = with_row_key(pages.select("page_id", "url", "html"), "_row")
    # Which rows share a payload is settled on narrow rows; payloads move once, under the key of their own row.
    narrow = stage(keyed.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col("page_id").cast("long").alias("id"), F.sha1(payload).alias("sha")), "digests")
    firsts = narrow.groupBy("sha").agg(F.min("id").alias("first"))
    marks = narrow.join(firsts, "sha")
    met = keyed.join(marks, [F.col(k) == F.col(f"k{i}") for i, k in enumerate(keys)])
    met = met.select(F.col("id").alias("page_id"), "url", surt(F.col("url")).alias("key"), "sha", payload.alias("payload"), "first")
    again = ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= min_revisit_bytes)
    met = met.select("page_id", "url", "key", "sha", F.octet_length("payload").cast("long").alias("size"), F.when(~again, F.col("payload")).alias("payload"), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(root)
        fs.create_dir(folder, recursive=True)
        name, out, at = "", None, 0
        for batch in batches:
            made: list[list] = [[], [], [], [], []]
            for r in zip(*(c.to_pylist() if i != 5 else c for i, c in enumerate(batch.columns))):
                if out is None or at > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(r[3])).decode()
                data = record_bytes(r[0], r[1], digest, r[4], r[5].as_py(), r[6])
                out.write(data)
                for col, v in zip(made, (r[2], r[0], name, at, len(data))):
                    col.append(v)
                at += len(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(made, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                ["key", "page_id", "file", "offset", "length"],
            )
        if out is not None:
            out.close()

    return stage(met.mapInArrow(run, "key string, page_id long, file string, offset long, length long"), "captures")


def write_index(captures: DataFrame, root: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorts the captures into shards of compressed blocks; returns ``shard``, ``first_key``, ``last_key``, stored.

    One row per shard, at most one shard per sort partition. A key with very many captures may span blocks
    and shards.
    """
    ranged = captures.repartitionByRange(F.col("key"), F.col("page_id"), F.col("file"), F.col("offset")).sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(root)
        fs.create_dir(folder, recursive=True)
        shard = uuid.uuid4().hex
        out, at, first, last, lines = None, 0, None, None, []
        directory: list[list] = []

        def flush() -> None:
            nonlocal out, at, lines
            if out is None:
                out = fs.open_output_stream(f"{folder}/{shard}.cdx", compression=None)
            data = zlib.compress("\n".join(lines).encode(), 6)
            out.write(data)
            directory.append([json.loads(lines[0])[0], at, len(data)])
            at, lines = at + len(data), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                first, last = row[0] if first is None else first, row[0]
                lines.append(json.dumps(row))
                if len(lines) >= block_lines:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{folder}/{shard}.dir", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([first]), pa.array([last])], ["shard", "first_key", "last_key"])

    return stage(ranged.mapInArrow(run, "shard string, first_key string, last_key string"), "shards")


def look_up(keys: DataFrame, shards: DataFrame, root: str) -> DataFrame:
    """Captures of each distinct ``key``: ``key``, ``page_id``, ``file``, ``offset``, ``length``.

    The driver and the tasks see one row per shard, that is per partition of the index sort. Keys go to the tasks of
    the shards that may have them; there a shard's directory is searched, and blocks are read one at a time.
    """
    order = sorted((r["first_key"], r["last_key"], r["shard"]) for r in shards.collect())
    firsts, lasts, names = ([o[i] for o in order] for i in range(3))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for key in batch.column(0).to_pylist():
                for i in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                    out[0].append(names[i])
                    out[1].append(key)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], ["shard", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(root)
        shard, file, directory, starts, block, lines = None, None, [], [], None, []
        for batch in batches:
            made: list[list] = [[], [], [], [], []]
            for name, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != shard:
                    shard, block = name, None
                    file = fs.open_input_file(f"{folder}/{name}.cdx")
                    with fs.open_input_stream(f"{folder}/{name}.dir", compression=None) as f:
                        directory = json.loads(zlib.decompress(f.read()))
                    starts = [d[0] for d in directory]
                # The key may begin in the block before the first that starts with it.
                for i in range(max(0, bisect_left(starts, key) - 1), bisect_right(starts, key)):
                    if block != i:
                        block = i
                        file.seek(directory[i][1])
                        lines = [json.loads(x) for x in zlib.decompress(file.read(directory[i][2])).decode().split("\n")]
                    for at in range(bisect_left(lines, key, key=lambda x: x[0]), len(lines)):
                        if lines[at][0] != key:
                            break
                        for col, v in zip(made, lines[at]):
                            col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(made, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                ["key", "page_id", "file", "offset", "length"],
            )

    asked = keys.select("key").distinct().mapInArrow(route, "shard string, key string")
    asked = asked.repartition("shard").sortWithinPartitions("shard", "key")
    return asked.mapInArrow(search, "key string, page_id long, file string, offset long, length long")


def read_records(captures: DataFrame, root: str) -> DataFrame:
    """The records of ``captures``, read by ranges in the order of the archives and checked.

    Tasks are numbered by the bytes of the records, not by the captures, which are narrow: each takes stretches of
    archives of STRETCH_BYTES. ``captures`` is stored, as it is read for its sum first.
    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` and
    ``payload`` (null for a revisit). A payload that does not fit its digest raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(root)
        name, file, lo, data = None, None, 0, b""
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns)))
            for at in range(0, len(places), 500):
                out: list[list] = [[], [], [], [], [], []]
                for i, (where, offset, length) in enumerate(places[at : at + 500], at):
                    if where != name:
                        name, file, data = where, fs.open_input_file(f"{folder}/{where}"), b""
                    if not lo <= offset <= offset + length <= lo + len(data):
                        end = offset + length  # with the records that follow closely
                        for w, o, n in places[i + 1 :]:
                            if w != where or o > end + 4096 or o + n - offset > READ_BYTES:
                                break
                            end = o + n
                        file.seek(offset)
                        lo, data = offset, file.read(end - offset)
                    page_id, size, digest, kind, refers, payload = parse_record(data[offset - lo : offset - lo + length])
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"record at {where}:{offset} does not fit its digest")
                    for col, v in zip(out, (page_id, size, digest, kind, refers, payload if kind == "response" else None)):
                        col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
                )

    places = stage(captures.select("file", "offset", "length"), "places")
    total = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(places.sparkSession.sparkContext.defaultParallelism, -(-total // STRETCH_BYTES))
    stretch = F.floor(F.col("offset") / F.lit(STRETCH_BYTES))
    placed = places.repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset")
    return placed.mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes ``pages`` to archives, indexes them, looks every page's key up and reads the records back.

    Columns: ``page_id``, ``payload_bytes``, ``payload_digest`` (bare base32 SHA-1), ``record_type``
    and ``refers_to``. Of equal payloads of at least ``min_revisit_bytes`` bytes the smallest page_id is
    the response, the others revisit it.

    Null html is an empty payload; null and odd addresses get keys without host and are found
    all the same. Repeated rows are a record each; those that share the smallest page_id of a
    payload are all responses. A null page_id revisits, unless all of its payload are null. An empty table
    gives an empty result, and other columns are ignored.
    """
    root = archive_root(pages.sparkSession)
    captures = write_archives(pages, root, min_revisit_bytes)
    shards = write_index(captures, root)
    found = look_up(pages.select(surt(F.col("url")).alias("key")), shards, root)
    return read_records(found, root).drop("payload")
