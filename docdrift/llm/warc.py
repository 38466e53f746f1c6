"""WARC archives: writing pages as records, and a reader that splits files.

Each record is a gzip member of its own. The reader gives every task a byte
range of a file. A task looks for the gzip magic from the start of its range
on, accepts a candidate when the member decodes to a WARC header whose length
and checksum agree and another member or the end of the file follows, and from
there on reads member after member. It owns the records that start inside its
range, so every record is read once wherever the ranges are cut.

Archives are written by the tasks, through ``pyarrow.fs``, to a folder that
driver and executors share. A file counts once its row is in the manifest: a
lost or repeated task leaves a file that nothing lists.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage
from .bpe import BATCH_BYTES, by_bytes
from .tables import table

#: Records with smaller payloads are never written as revisits.
MIN_BYTES = 0
#: Bytes after which a task starts another file, and bytes of a reader's range.
FILE_BYTES, RANGE_BYTES = 1 << 30, 8 << 20
#: Tasks that read ranges at most.
MOST_TASKS = 65_536

_MAGIC = b"\x1f\x8b\x08"
_BLOCK = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:record:"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    local = re.match(r"file:/+(.*)", uri)
    return fs.FileSystem.from_uri(f"/{local[1]}" if local else uri)


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(record: object) -> str:
    return f"<{_URN}{'' if record is None else quote(str(record), safe='')}>"


def _unname(value: str | None) -> str | None:
    found = value and value.strip("<>").removeprefix(_URN)
    return unquote(found) if found else None


def record_member(
    record: object, uri: str | None, payload: bytes, refers_to: object, revisit: bool, date: str, digest: str
) -> bytes:
    """A response or revisit record as a gzip member. A revisit carries the
    HTTP header of the full response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _name(record),
        "WARC-Date": date,
        "WARC-Target-URI": uri and quote(uri, safe="%:/?#[]@!$&'()*+,;=~-._"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Refers-To": _name(refers_to) if revisit else None,
        "WARC-Profile": _PROFILE if revisit else None,
        "Content-Type": "application/http;msgtype=response",
    }
    return _member(fields, block)


def _member(fields: dict[str, str | None], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in (fields | {"Content-Length": str(len(block))}).items() if v]
    head = "\r\n".join(["WARC/1.1", *lines, "", ""]).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def _info(date: str) -> bytes:
    fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}
    return _member(fields, b"format: WARC File Format 1.1\r\n")


def write_warc(
    df: DataFrame,
    folder: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = MIN_BYTES,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record per row below ``folder`` (a shared folder or store) and
    return the stored manifest ``path, bytes, records``.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with
    the largest id is the response and the others are revisits that refer to
    it; records with smaller payloads are all responses. Rows that repeat the
    largest id are all responses, and where all ids are null no row can be
    referred to, so all are. Null payloads count as empty, null or empty URIs
    are left out. Ids should be unique for record ids to be.
    """
    text = F.col(payload_col)
    payload = F.coalesce(text.cast("binary"), F.lit(b""))
    pages = df.select(
        F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha")
    )
    large = pages.where(F.octet_length("payload") >= min_bytes).groupBy("sha")
    repeated = large.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where("n > 1 AND last IS NOT NULL")
    # Only repeated payloads are in the table; it is broadcast only if its
    # measured size allows it.
    repeated = cut_lineage(repeated.select("sha", "last"))
    marked = pages.join(repeated, "sha", "left").withColumn(
        "revisit",
        (F.octet_length("payload") >= min_bytes) & F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")),
    )
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        task = TaskContext.get()
        base = f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        out, path, size, records, files = None, "", 0, 0, 0
        listed: list[tuple[str, int, int]] = []
        for batch in by_bytes(batches, "payload"):
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    path = f"{base}-{files:04d}.warc.gz"
                    out, first = store.open_output_stream(path, compression=None), _info(date)
                    out.write(first)
                    size, records, files = len(first), 0, files + 1
                member = record_member(
                    row["id"], row["uri"], row["payload"], row["last"], row["revisit"], date, base64.b32encode(row["sha"]).decode()
                )
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= file_bytes:
                    out.close()
                    listed.append((path, size, records))
                    out = None
        if out is not None:
            out.close()
            listed.append((path, size, records))
        if listed:
            names, sizes, counts = zip(*listed, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["path", "bytes", "records"]
            )

    scheme = folder.split("://", 1)[0] + "://" if "://" in folder and not folder.startswith("file:") else ""
    manifest = marked.select("id", "uri", "payload", "sha", "last", "revisit").mapInArrow(
        run, "path string, bytes long, records long"
    )
    return cut_lineage(manifest.withColumn("path", F.concat(F.lit(scheme), "path")) if scheme else manifest)


class _Bytes:
    """A file read forward in blocks, with its position."""

    def __init__(self, source: pa.NativeFile, size: int) -> None:
        self.source, self.size, self.start, self.held = source, size, 0, b""

    def at(self, place: int, count: int) -> bytes:
        """Up to ``count`` bytes from ``place`` on."""
        if not self.start <= place <= place + count <= self.start + len(self.held):
            self.source.seek(place)
            self.start, self.held = place, self.source.read(max(count, _BLOCK))
        return self.held[place - self.start : place - self.start + count]


def _decode(data: _Bytes, place: int) -> tuple[dict[str, str], bytes, int] | None:
    """Header fields, block and end of the member at ``place``; None where no
    whole WARC record starts."""
    unpack, content, here = zlib.decompressobj(31), b"", place
    parts: list[bytes] = []
    seen = 0
    try:
        while not unpack.eof:
            raw = data.at(here, min(_BLOCK, data.size - here))
            if not raw:
                return None
            parts.append(unpack.decompress(raw))
            seen += len(parts[-1])
            here += len(raw)
            if len(parts) == 1 and not b"WARC/".startswith(parts[0][:5]) and not parts[0].startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    content = b"".join(parts)
    head, mark, block = content.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/"):
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = fields.get("content-length", "")
    if not length.isdigit() or len(block) != int(length) + 4:
        return None
    return fields, block[: int(length)], here - len(unpack.unused_data)


def _records(data: _Bytes, start: int, stop: int) -> Iterator[tuple[dict[str, str], bytes]]:
    place, inside = start, start == 0
    while place < min(stop, data.size):
        found = _decode(data, place) if data.at(place, 3) == _MAGIC else None
        if found and not inside:
            end = found[2]
            inside = end == data.size or (data.at(end, 3) == _MAGIC and _decode(data, end) is not None)
            if not inside:
                found = None
        if found:
            yield found[:2]
            place = found[2]
            continue
        inside = False
        place += 1
        while place < min(stop, data.size):  # the next candidate
            held = data.at(place, min(_BLOCK, data.size - place))
            at = held.find(_MAGIC)
            if at >= 0:
                place += at
                break
            place += max(1, len(held) - 2)


def _fields(fields: dict[str, str], block: bytes) -> tuple:
    """The row of a record."""
    kind = fields.get("warc-type")
    head, _, body = block.partition(b"\r\n\r\n") if "application/http" in fields.get("content-type", "") else (b"", b"", block)
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
    payload = None if kind == "revisit" else body
    named = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    digest = named if payload is None else digest32(payload)
    return (
        _unname(fields.get("warc-record-id")),
        kind,
        unquote(fields["warc-target-uri"]) if fields.get("warc-target-uri") else None,
        _unname(fields.get("warc-refers-to")),
        digest,
        int(length[1]) if length else len(body),
        payload,
        named is None or named == digest,
    )


RECORD = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary, intact boolean"
)


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES, most_tasks: int = MOST_TASKS) -> DataFrame:
    """The records of ``files(path, bytes)``, whoever wrote them.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload: as
    read for responses, as recorded for revisits (whose ``payload`` is null).
    ``intact`` is false where a payload does not have the recorded digest.
    Members that are not whole WARC records are passed over; empty files have
    no records."""
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.select("path", "bytes", cuts.alias("start")).where("bytes > 0")
    # A few bytes each, so the number of tasks has to be named; beyond the most
    # tasks a stage should have, each takes several ranges one after another.
    spread = ranges.repartition(max(1, min(ranges.count(), most_tasks)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.bool_()]
        names = [c.split()[0] for c in RECORD.split(", ")]
        rows, held = [], 0
        for row in (r for b in batches for r in b.to_pylist()):
            store, path = _store(row["path"])
            with store.open_input_file(path) as source:
                data = _Bytes(source, row["bytes"])
                for fields, block in _records(data, row["start"], row["start"] + range_bytes):
                    rows.append(_fields(fields, block))
                    held += len(block)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spread.mapInArrow(run, RECORD)


def warc_round_trip(
    df: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", **limits: int
) -> DataFrame:
    """Write ``df`` as archives and read them back, one row per row, with
    ``record_id`` and ``refers_to`` in the id's type. An empty table writes no
    file and gives an empty result."""
    kind = df.schema[id_col].dataType
    ranges = {k: v for k, v in limits.items() if k in ("range_bytes", "most_tasks")}
    manifest = write_warc(df, folder, id_col, uri_col, payload_col, **{k: v for k, v in limits.items() if k not in ranges})
    records = read_warc(manifest, **ranges).where("record_type <> 'warcinfo'")
    return records.withColumns({c: F.col(c).cast(kind) for c in ("record_id", "refers_to")})


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/docdrift-warc-{uuid.uuid4().hex}"
    back = warc_round_trip(table(spark, sf_dir, "pages"), folder)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
