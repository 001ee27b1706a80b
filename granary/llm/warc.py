"""Web archives: legacy ARC files to WARC, revisits, and reading both back.

An ARC file begins with a version block: ``filedesc://`` line, then a line with the version, which says how each
record's header line reads (version 1: URL, IP, date, type, length; version 2 adds a result code, checksum, location,
offset and file name), then the fields' names. Each record is its header line and as many bytes as it declares. The
converter reads these and makes WARC records of the same content: an id from URL, date and content (so that converting
again gives the same id), the date as W3C time, a type (response for HTTP, resource otherwise, warcinfo for the version
block), and SHA-1 digests of block and payload.

A record whose payload another record has already becomes a revisit: its block is cut after the HTTP header, its digest
stays that of the whole payload, and WARC-Refers-To, -Target-URI and -Date name the other record by the id that the
converter gives that one. Which record that is, is found from the ARC archives themselves (``arc_records``): payloads
meet by digest, a row of some hundred bytes for each record and none of its content. The archives are settled in buckets
by name, so the converter gets what it needs to know of each while its content stays where it is; the ARC archives are
deleted when the WARC ones are written.

Archives are rows of a table with binary content, so any storage that Spark writes can hold them; ``read_warc`` takes
the rows of ``spark.read.format("binaryFile")`` as well. Each archive holds records of one task up to ARCHIVE bytes and
each record is a gzip member of its own, as archives usually have it; archives that aren't compressed are read too.

Damage (bytes that are no record, a record cut off, a member that doesn't unpack) is counted: reading goes on at the
next header or member that can be read, and rows with ``damaged`` bytes say what was skipped, in the ARC archives as in
the WARC ones. With ``strict`` it is an error instead. Null html counts as an empty payload; a null or empty url is
written as ``about:blank``. Rows alike have a record each; a null id is never a revisit, nor referred to. Of equal
payloads the largest id is the response; rows that share it are all responses. An empty table gives no archives. Extra
columns are not returned, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from granary.llm.common import discard, parts_for, settle, settle_dealt, tuned

ARCHIVE = 4 << 20
#: Payloads of fewer bytes are never revisits.
LEAST = 1000
_GZIP = b"\x1f\x8b\x08"
#: A line break and, after it, what looks like a record's header line.
_ARC_LINE = re.compile(rb"\n(?=[a-z][a-z0-9+.-]*:[^\n]* [0-9a-f.:]+ [0-9]{8,14} [^\n]* [0-9]+\r?\n)")
NAMES = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}


def _clean(url: str | None) -> str:
    return re.sub(r"\s", "%20", url) if url else "about:blank"


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 granary\n{NAMES[version]}\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str | None, date: str, mime: str, block: bytes, name: str = "a.arc", at: int = 0) -> bytes:
    extra = f" 200 {hashlib.md5(block).hexdigest()} - {at} {name}" if version == 2 else ""
    return f"{_clean(url)} 0.0.0.0 {date} {mime}{extra} {len(block)}\n".encode() + block + b"\n"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def _members(data: bytes) -> Iterator[tuple[bytes | None, int]]:
    """(content of a gzip member, or of all if it isn't compressed; 0), or (None, bytes that cannot be unpacked)."""
    if data[:2] != _GZIP[:2]:
        yield data, 0
        return
    at, view = 0, memoryview(data)
    while at < len(data):
        z, parts, end = zlib.decompressobj(31), [], at
        try:
            while not z.eof and end < len(data):
                parts.append(z.decompress(view[end : end + (1 << 14)]))
                end = min(len(data), end + (1 << 14))
            whole = z.eof
        except zlib.error:
            whole = False
        if whole:
            at = end - len(z.unused_data)
            yield b"".join(parts), 0
            continue
        after = data.find(_GZIP, at + 1)
        yield None, (after if after > 0 else len(data)) - at
        at = after if after > 0 else len(data)


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str] | None, bytes]]:
    """(header fields, block) of each record, gzipped by record or not; (None, bytes) for what isn't one."""
    names = NAMES[1].split()
    for member, lost in _members(data):
        if member is None:
            yield None, b"\0" * lost
            continue
        at = 0
        while at < len(member):
            if member[at : at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            end = member.find(b"\n", at)
            fields = member[at:end].decode("utf-8", "replace").rstrip("\r").split(" ") if end > 0 else []
            if len(fields) < 5 or not re.fullmatch(r"[0-9]+", fields[-1]) or end + 1 + int(fields[-1]) > len(member):
                after = _ARC_LINE.search(member, max(at, end) if end > 0 else len(member))
                stop = after.start() + 1 if after else len(member)
                yield None, member[at:stop]
                at = stop
                continue
            n = int(fields[-1])
            block = member[end + 1 : end + 1 + n]
            at = end + 1 + n
            if fields[0].startswith("filedesc://"):
                lines = block.decode("utf-8", "replace").split("\n")
                version = lines[0].split(" ")[0]
                names = lines[1].split(" ") if len(lines) > 1 and lines[1].startswith("URL") else NAMES[2 if version == "2" else 1].split()
                yield {"URL": fields[0], "Archive-date": fields[2], "Content-type": "text/plain", "version": version}, block
                continue
            if len(fields) != len(names):  # blanks inside the URL: take the other fields from the right
                fields = [" ".join(fields[: len(fields) - len(names) + 1]), *fields[len(fields) - len(names) + 1 :]]
            yield dict(zip(names, fields)), block


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def w3c(date: str) -> str:
    d = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() and len(date) >= 4 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def block_parts(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload."""
    end = block.find(b"\r\n\r\n")
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (block, b"")


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP fields (lower-case names) and payload of a block."""
    head, payload = block_parts(block)
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    return fields, payload


def page_id_of(http: dict[str, str]) -> int | None:
    """The id of a page that write_arc has written."""
    return int(http["x-page-id"]) if re.fullmatch(r"-?[0-9]{1,18}", http.get("x-page-id", "")) else None


def convert(header: dict[str, str], block: bytes, same: tuple[str, str, str] | None = None) -> tuple[dict[str, str], bytes]:
    """The WARC header fields that mean the same as an ARC record's, and the block. ``same`` is (record id, URI, date) of
    the record that has the payload already."""
    url, date = header["URL"], w3c(header.get("Archive-date", ""))
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{url}|{date}|{hashlib.sha1(block).hexdigest()}")
    out = {"WARC-Type": "", "WARC-Record-ID": f"<urn:uuid:{own}>", "WARC-Date": date, "WARC-Target-URI": url}
    if "version" in header:
        out |= {"WARC-Type": "warcinfo", "Content-Type": "application/warc-fields", "WARC-Filename": url.removeprefix("filedesc://")}
        del out["WARC-Target-URI"]
        block = f"software: granary\r\nformat: WARC File Format 1.0\r\nconverted-from: ARC {header['version']}\r\n".encode()
    elif block.startswith(b"HTTP/"):
        head, payload = block_parts(block)
        out |= {"WARC-Type": "response", "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(payload)}
        if same is not None:
            block = head
            out |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"}
            out |= dict(zip(("WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date"), same))
    else:
        out |= {"WARC-Type": "resource", "Content-Type": header.get("Content-type", "application/octet-stream"), "WARC-Payload-Digest": digest(block)}
    return out | {"WARC-Block-Digest": digest(block)}, block


def warc_record(header: dict[str, str], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in header.items()]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def gzipped(record: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def read_records(data: bytes) -> Iterator[tuple[dict[str, str] | None, bytes]]:
    """(header fields, block) of each record of a WARC archive, gzipped by record or not; (None, bytes) for what isn't
    one."""
    for record, lost in _members(data):
        if record is None:
            yield None, b"\0" * lost
            continue
        at = 0
        while at < len(record):
            if record[at : at + 2] == b"\r\n":
                at += 2
                continue
            end = record.find(b"\r\n\r\n", at)
            lines = record[at:end].decode("utf-8", "replace").split("\r\n") if end > 0 else [""]
            header = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
            size = header.get("Content-Length", "")
            if not lines[0].startswith("WARC/") or not re.fullmatch(r"[0-9]+", size) or end + 4 + int(size) > len(record):
                after = record.find(b"\r\nWARC/", at)
                stop = after + 2 if after >= 0 else len(record)
                yield None, record[at:stop]
                at = stop
                continue
            at = end + 4 + int(size)
            yield header, record[end + 4 : at]


_ARCHIVE = "archive string, version int, content binary"
_WARC = "archive string, content binary, records int, damaged long"
_TOLD = "archive string, at int, key binary, payload_bytes long, page_id long, record_id string, uri string, date string"
_RECORD = "archive string, record_type string, record_id string, target_uri string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, damaged long, payload binary"
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def write_arc(df: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """ARC archives of pages, gzipped by record; versions take turns."""
    tuned(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        task = TaskContext.get().partitionId()

        def done() -> pa.RecordBatch:
            name = f"{hashlib.sha1(b''.join(x[:64] for _, x in held)).hexdigest()[:16]}-{task}-{number}.arc"
            version = 1 + int(name[0], 16) % 2
            body = [gzipped(version_block(version, name, "20240101000000"))]
            at = len(body[0])
            for u, block in held:
                body.append(gzipped(arc_record(version, u, "20240101000000", "text/html", block, name, at)))
                at += len(body[-1])
            return _batch([(name, version, b"".join(body))], _ARCHIVE)

        for batch in batches:
            for i, u, t in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((u, http_block(i, (t or "").encode())))
                size += len(held[-1][1])
                if size >= ARCHIVE:
                    yield done()
                    held, size, number = [], 0, number + 1
        if held:
            yield done()

    return df.select(F.col(id_col).cast("long"), F.col(url), F.col(html)).mapInArrow(work, _ARCHIVE)


def arc_records(arcs: DataFrame) -> DataFrame:
    """What the converter needs to know of each record of ARC archives (archive, content) to find equal payloads: its
    number in the archive, a digest of the payload (null if it isn't HTTP), and the id, URI and date it gets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for at, (header, block) in enumerate(read_arc(content or b"")):
                    if header is None or "version" in header or not block.startswith(b"HTTP/"):
                        continue
                    http, payload = payload_of(block)
                    fields, _ = convert(header, block)
                    rows.append((name, at, hashlib.sha256(payload).digest(), len(payload), page_id_of(http), fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"]))
                yield _batch(rows, _TOLD)

    return arcs.select("archive", "content").mapInArrow(work, _TOLD)


def revisits_of(told: DataFrame, least: int = LEAST) -> DataFrame:
    """archive, same: for each archive the numbers of its records that are revisits, and the records they refer to. Of
    equal payloads of at least ``least`` bytes the one with the largest page_id is the response."""
    known = told.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    of = F.struct("page_id", "record_id", "uri", "date")
    best = known.groupBy("key").agg(F.max(of).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "best")
    found = known.select("key", "archive", "at", "page_id").join(best, "key").filter("page_id <> best.page_id")
    return found.groupBy("archive").agg(F.collect_list(F.struct("at", "best.record_id", "best.uri", "best.date")).alias("same"))


def arc_to_warc(arcs: DataFrame, revisits: DataFrame | None = None) -> DataFrame:
    """WARC archives of ARC archives (archive, content), with the records that ``revisits`` names cut to their headers,
    the number of records and the damaged bytes of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, same in zip(*(c.to_pylist() for c in batch.columns)):
                known = {x["at"]: (x["record_id"], x["uri"], x["date"]) for x in same or ()}
                out, damaged = [], 0
                for at, (header, block) in enumerate(read_arc(content or b"")):
                    if header is None:
                        damaged += len(block)
                    else:
                        out.append(gzipped(warc_record(*convert(header, block, known.get(at)))))
                yield _batch([(re.sub(r"\.arc$", "", name) + ".warc.gz", b"".join(out), len(out), damaged)], _WARC)

    if revisits is None:
        with_same = arcs.select("archive", "content", F.lit(None).cast("array<struct<at: int, record_id: string, uri: string, date: string>>").alias("same"))
    else:
        with_same = arcs.select("archive", "content").join(revisits.hint("shuffle_hash"), "archive", "left").select("archive", "content", "same")
    return with_same.mapInArrow(work, _WARC)


def read_warc(archives: DataFrame, name: str = "archive", content: str = "content", payloads: bool = False, strict: bool = False) -> DataFrame:
    """One row per response, resource and revisit record, and one with ``damaged`` bytes for each piece of an archive
    that is no record."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for header, block in read_records(data or b""):
                    if header is None:
                        if strict:
                            raise ValueError(f"{archive}: {len(block)} damaged bytes")
                        rows.append((archive, *[None] * 8, len(block), None))
                        continue
                    kind = header.get("WARC-Type")
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    http, payload = payload_of(block) if block.startswith(b"HTTP/") else ({}, block)
                    size, sha = len(payload), hashlib.sha1(payload).hexdigest()
                    if kind == "revisit":
                        told = http.get("content-length", "")
                        size = int(told) if re.fullmatch(r"[0-9]+", told) else None
                        sha = _plain(header.get("WARC-Payload-Digest", ""))
                    rows.append((archive, kind, header.get("WARC-Record-ID"), header.get("WARC-Target-URI"), header.get("WARC-Date"), page_id_of(http), size, sha, header.get("WARC-Refers-To"), 0, payload if payloads else None))
                yield _batch(rows, _RECORD)

    return archives.select(F.col(name), F.col(content)).mapInArrow(work, _RECORD)


def _plain(value: str) -> str | None:
    """A SHA-1 digest field as lower-case hex; null if it is another kind or can't be read."""
    value = value.removeprefix("sha1:")
    try:
        return value.lower() if re.fullmatch(r"[0-9a-fA-F]{40}", value) else base64.b32decode(value).hex() or None
    except ValueError:
        return None


def resolved(records: DataFrame) -> DataFrame:
    """Adds refers_to: the page_id of the record that a revisit refers to by its id. Size and digest of the payload come
    from there too where the revisit itself doesn't tell. Records that refer to none are dealt out by a number of their
    own, for all nulls would meet in one task."""
    named = records.filter("record_type <> 'revisit' and page_id is not null").groupBy(F.col("record_id").alias("__id")).agg(F.max(F.struct("page_id", "payload_bytes", "payload_digest")).alias("__of"))
    dealt = records.withColumn("__to", F.coalesce("refers_to_id", F.monotonically_increasing_id().cast("string")))
    both = dealt.join(named, (F.col("__to") == F.col("__id")) & F.col("refers_to_id").isNotNull(), "left")
    told = {c: F.coalesce(c, F.col(f"__of.{c}")) for c in ("payload_bytes", "payload_digest")}
    return both.select(*(told[c].alias(c) if c in told else c for c in records.columns), F.col("__of.page_id").alias("refers_to"))


def archive_pages(df: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", strict: bool = False) -> DataFrame:
    """Pages to ARC, to WARC with revisits, into the shared folder, and back: the records as read_warc and resolved give
    them, with a row of ``damaged`` bytes for an ARC archive that has some."""
    arcs = settle_dealt(write_arc(df, id_col, url, html), "archive", parts_for(df))
    told = settle(arc_records(arcs))
    revisits = settle(revisits_of(told))
    discard(told)
    warcs = settle(arc_to_warc(arcs, revisits))
    discard(revisits)
    discard(arcs)
    back = resolved(read_warc(warcs, strict=strict))
    lost = warcs.filter("damaged > 0").select("archive", "damaged")
    if strict:
        lost = lost.withColumn("damaged", F.raise_error(F.concat(F.col("archive"), F.lit(": damaged"))).cast("long"))
    return back.unionByName(lost, allowMissingColumns=True)
