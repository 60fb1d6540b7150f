"""WARC records as rows: written to bytes and parsed from them, as columns of a DataFrame.

A record is a version line, named fields, and a block; the block of a response or revisit is an HTTP message, whose
header fields come as a map of lower-case names (values of repeated fields are joined by ", "). ``parsed`` takes a column
of whole files, plain or of gzip members, of any number of records each, such as ``content`` of Spark's ``binaryFile``
source; a file must fit a task. What follows a damaged record of a file cannot be told apart, so the file ends there
with a row of kind ``damaged``. Null and empty files have no records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import pieces

VERSION = b"WARC/1.1"
#: What a revisit was found by (WARC 1.1, 6.7): fixed values.
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
SAME_DIGEST = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "record_id string, url string, ts long, kind string, profile string, payload_digest string, refers_to_uri string, refers_to_ts long, status int, etag string, last_modified string, headers map<string,string>, payload binary"


def date_of(ts: int) -> str:
    return datetime.fromtimestamp(ts, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def ts_of(date: str | None) -> int | None:
    """Seconds since 1970 of a WARC date; fractions are cut off; None if it is none."""
    try:
        return int(datetime.fromisoformat(date.strip()).replace(tzinfo=UTC).timestamp() // 1) if date else None
    except ValueError:
        return None


def record(named: dict[str, str | None], block: bytes) -> bytes:
    """One record of named fields (those that are None are left out) and a block."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in named.items() if v is not None), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def http(status: int, headers: dict[str, str], body: bytes = b"") -> bytes:
    lines = [f"HTTP/1.1 {status} -".encode(), *(f"{k}: {v}".encode() for k, v in headers.items())]
    return b"\r\n".join(lines) + b"\r\n\r\n" + body


def _inflated(data: bytes) -> bytes:
    """All gzip members of a file; a plain file as it is. A member that is cut short gives what it holds."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(data))
        except zlib.error:
            break
        data = d.unused_data
    return b"".join(out)


def _named(lines: list[bytes]) -> dict[str, str]:
    """Fields by lower-case name; a line that starts with a blank goes on with the one before it."""
    out: dict[str, str] = {}
    last = None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            last = name.strip().lower()
            out[last] = f"{out[last]}, {value.strip()}" if last in out else value.strip()
    return out


def records(data: bytes | None) -> Iterator[tuple[dict[str, str], bytes] | None]:
    """Named fields and block of each record of a file; None, and nothing after it, for a damaged one."""
    data, at = _inflated(data or b""), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].split(b"\r\n") if end >= 0 else [b""]
        named = _named(head[1:])
        size = named.get("content-length", "")
        if not head[0].startswith(b"WARC/") or not size.isdecimal() or end + 4 + int(size) > len(data):
            yield None
            return
        start = end + 4
        at = start + int(size)
        yield named, data[start:at]
        while data[at : at + 2] == b"\r\n":
            at += 2


def row(found: tuple[dict[str, str], bytes] | None) -> tuple:
    """A record as a row of FIELDS."""
    if found is None:
        return (None, None, None, "damaged", *[None] * 9)
    named, block = found
    kind = named.get("warc-type")
    status = headers = payload = None
    if kind in ("response", "revisit") and block.startswith(b"HTTP/"):
        head, _, payload = block.partition(b"\r\n\r\n")
        first, *rest = head.split(b"\r\n")
        word = first.split()[1:2]
        status, headers = (int(word[0]) if word and word[0].isdigit() else None), _named(rest)
    get = (headers or {}).get
    uri = lambda k: v.strip("<>") if (v := named.get(k)) else None
    return (
        uri("warc-record-id"), uri("warc-target-uri"), ts_of(named.get("warc-date")), kind, named.get("warc-profile"), named.get("warc-payload-digest"),
        uri("warc-refers-to-target-uri"), ts_of(named.get("warc-refers-to-date")), status, get("etag"), get("last-modified"), headers, payload,
    )


def parsed(files: DataFrame, content: str = "content", payload: bool = False) -> DataFrame:
    """A row of FIELDS for each record of the files (without ``payload`` unless asked for)."""
    schema = T.StructType.fromDDL(FIELDS) if payload else T.StructType(T.StructType.fromDDL(FIELDS).fields[:-1])
    kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 256, content):
                rows = [row(r) for f in part.column(content).to_pylist() for r in records(f)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
                cols = [[list(x.items()) if x is not None else None for x in c] if pa.types.is_map(k) else c for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: len(schema)], names=schema.names)

    return files.select(content).mapInArrow(run, schema)


#: What a record is written from, and the types.
GIVEN = {"record_id": "string", "url": "string", "ts": "long", "kind": "string", "profile": "string", "status": "int", "headers": "map<string,string>", "body": "binary"}


def written(df: DataFrame, out: str = "content") -> DataFrame:
    """``out``, the record of each row as bytes, beside its record_id: record_id, url, ts, kind, and optionally profile, status, headers and body (binary)."""
    given = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in GIVEN.items()]
    angle = lambda v: None if v is None else f"<{v}>"

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 256, "body"):
                made = []
                for i, url, ts, kind, profile, status, headers, body in zip(*(part.column(c).to_pylist() for c in GIVEN), strict=True):
                    named = {"WARC-Type": kind, "WARC-Record-ID": angle(i), "WARC-Target-URI": url, "WARC-Date": None if ts is None else date_of(ts), "WARC-Profile": profile, "Content-Type": "application/http"}
                    made.append(record(named, http(status or 200, dict(headers or ()), body or b"")))
                yield pa.RecordBatch.from_arrays([part.column("record_id"), pa.array(made, pa.binary())], names=["record_id", out])

    return df.select(*given).mapInArrow(run, f"record_id string, {out} binary")
