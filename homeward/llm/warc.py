"""Legacy web archives (ARC, versions 1 and 2) to WARC, and WARC read back.

An ARC record is a line of fields, the last of which declares the length of what follows; which
fields there are depends on the archive's version, given in its first record. The converter
parses these, and makes up what WARC asks for beyond: identifiers, ISO dates, record types and
digests. Of records with equal payloads one is a response, the others are revisits without it.

Which record refers to which is decided on rows without payloads; archives are then converted
whole, each with the list of its revisits, so no payload is shuffled by its digest and a payload
that very many pages share is no hot key. WARC files have one gzip member for each record, after
one that describes the file, and may hold any bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homeward.llm.common import Scratch, giving_back, slices

#: Fields of a URL record by version (fixed by the format).
FIELDS = {
    1: ["url", "ip", "date", "mime", "length"],
    2: ["url", "ip", "date", "mime", "code", "checksum", "location", "offset", "filename", "length"],
}
TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def escaped(url: str | None) -> str:
    """The URL without blanks or control characters; "-" for none, as ARC has it."""
    return UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "-"


def arc_head(version: int, date: str, name: str = "homeward.arc") -> bytes:
    body = f"{version} 0 homeward\n{TITLES[version]}\n".encode()
    more = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, block: bytes, offset: int, name: str = "homeward.arc") -> bytes:
    more = "" if version == 1 else f" 200 {zlib.crc32(block):08x} - {offset} {name}"
    return f"{url} 0.0.0.0 {date} text/html{more} {len(block)}\n".encode() + block + b"\n"


#: How a record's line begins; where to look for the next one after damage.
LINE = re.compile(rb"\n(?=[A-Za-z][A-Za-z0-9+.-]*:\S* \S+ \d{4,14} )")


def read_arc(blob: bytes) -> Iterator[dict]:
    """The URL records of an archive, each with its ``block``.

    For what is not a record's line, or declares more than is there, a row has the reason as
    ``problem`` and the place as ``at``; reading goes on at the next line that looks like a
    record's. Without a readable version block there is one such row and no record."""
    at, version = 0, None
    while at < len(blob):
        if blob[at] in b"\r\n":  # the separators of records
            at += 1
            continue
        end = blob.find(b"\n", at)
        line = blob[at : end if end >= 0 else len(blob)].decode("utf-8", "replace").rstrip("\r")
        if version is None:
            parts = line.split(" ")
            if not line.startswith("filedesc://") or not parts[-1].isdigit():
                yield {"problem": "no version block", "at": at}
                return
            body = blob[end + 1 : end + 1 + int(parts[-1])]
            first = body.split(b" ", 1)[0]
            version = int(first) if first.isdigit() else 0
            if version not in FIELDS or end < 0:
                yield {"problem": f"version {first[:20]!r}", "at": at}
                return
            at = end + 1 + int(parts[-1])
            continue
        names = FIELDS[version]
        parts = line.split(" ")
        if len(parts) > len(names):  # only the media type may have blanks
            extra = len(parts) - len(names)
            parts = [*parts[:3], " ".join(parts[3 : 4 + extra]), *parts[4 + extra :]]
        wrong = end < 0 or len(parts) != len(names) or not parts[-1].isdigit()
        if wrong or end + 1 + int(parts[-1]) > len(blob):
            yield {"problem": "not a record line" if wrong else "cut short", "at": at}
            next_line = LINE.search(blob, at)
            if not next_line:
                return
            at = next_line.end()
            continue
        found = dict(zip(names, parts, strict=True))
        n = int(found["length"])
        yield found | {"block": blob[end + 1 : end + 1 + n], "problem": None, "at": at}
        at = end + 1 + n


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with the blank line) and payload of an HTTP response; all payload if it is none."""
    if block.startswith(b"HTTP/") and (end := block.find(b"\r\n\r\n")) >= 0:
        return block[: end + 4], block[end + 4 :]
    return b"", block


def header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def iso(date: str) -> str:
    """14 digits (or fewer, from the left) as WARC's date; what is no date becomes the epoch."""
    d = date[:14] if date[:4].isdigit() else ""
    d += "19700101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, name: str) -> str:
    """Depends on the record alone, so a task that runs again makes the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {name}')}>"


def warc_record(kind: str, rid: str, fields: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(date: str, name: str) -> bytes:
    """What describes an archive, at its beginning."""
    block = b"software: homeward\r\nformat: WARC File Format 1.1\r\n"
    fields = {"WARC-Date": iso(date), "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/warc-fields"}
    return warc_record("warcinfo", record_id("info", date, "", name), fields, block)


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own, without a time, so the same record is the same bytes."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def inflated(blob: bytes, each: int = 1 << 18) -> Iterator[bytes]:
    """What the gzip members of a file hold, in portions."""
    at, z = 0, zlib.decompressobj(31)
    while at < len(blob):
        part = blob[at : at + each]
        at += len(part)
        yield z.decompress(part)
        if z.eof:
            at -= len(z.unused_data)
            z = zlib.decompressobj(31)


def read_warc(portions: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Head and block of each record; never holds more than a record and a portion."""
    held, place, more = bytearray(), 0, True
    while True:
        end = held.find(b"\r\n\r\n")
        n = -1
        if end >= 0:
            head = bytes(held[: end + 2])
            if not head.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at byte {place}")
            n = int(header(head, "Content-Length") or -1)
            if n < 0:
                raise ValueError(f"a WARC record without a length at byte {place}")
        if n >= 0 and len(held) >= end + 8 + n:
            yield head, bytes(held[end + 4 : end + 4 + n])
            del held[: end + 8 + n]
            place += end + 8 + n
            continue
        if not more:
            if held:
                raise ValueError(f"a WARC record is cut short at byte {place}")
            return
        portion = next(portions, None)
        more = portion is not None
        held += portion or b""


def to_arc(pages: DataFrame, date: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Legacy archives (``arc``, zlib) of the pages, in versions 1 and 2 by turns."""
    src = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.col(html).cast("string").cast("binary").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1
        for batch in batches:
            for part in slices(batch, "h"):
                out, at = [arc_head(version, date)], 0
                for k, u, h in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    at += len(out[-1])
                    body = h or b""
                    mark = "" if k is None else f"X-Page-Id: {k}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{mark}\r\n"
                    out.append(arc_record(version, escaped(u), date, head.encode() + body, at))
                yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(b"".join(out), 1)], pa.binary())], ["arc"])
                version = 3 - version

    return src.mapInArrow(giving_back(run), "arc binary")


RECORDS = "arc_id string, place int, page_id bigint, url string, date string, rid string, digest string, n_payload bigint, problem string"


def arc_name(blob: bytes) -> str:
    """Of a legacy archive, by its bytes (as SQL's sha1): equal archives have one name, and equal
    decisions."""
    return hashlib.sha1(blob).hexdigest()


def parsed(blob: bytes) -> Iterator[tuple[dict, bytes, bytes, str | None, str, str]]:
    """The records of an archive: fields, head, payload, page_id, digest and identifier."""
    for r in read_arc(blob):
        if not r["problem"]:
            head, payload = split_http(r["block"])
            k, d = header(head, "X-Page-Id"), digest(payload)
            yield r, head, payload, k, d, record_id(r["url"], r["date"], d, k or "")


def from_arc(arcs: DataFrame) -> DataFrame:
    """The records of legacy archives (``arc``, zlib) without their blocks, numbered in each
    archive; and a row for each place that is damaged, which names the problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("arc").to_pylist():
                whole, name = zlib.decompress(blob), arc_name(blob)
                rows = [(name, i, int(k) if k else None, r["url"], r["date"], rid, d, len(payload), None) for i, (r, _, payload, k, d, rid) in enumerate(parsed(whole))]
                rows += [(name, -1, *[None] * 6, f"{r['problem']} at {r['at']}") for r in read_arc(whole) if r["problem"]]
                kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], [f.split()[0] for f in RECORDS.split(", ")])

    return arcs.select("arc").mapInArrow(giving_back(run), RECORDS)


def problems(arcs: DataFrame) -> DataFrame:
    """(arc_id, problem): what of the archives could not be read."""
    return from_arc(arcs).where("problem IS NOT NULL").select("arc_id", "problem")


def revisits(records: DataFrame, least: int) -> DataFrame:
    """(id, revisits): of each archive the places of its revisits and what they refer to; from the
    rows of ``from_arc``.

    Of payloads of at least ``least`` bytes that are equal, the record with the largest page_id
    is the response (rows repeated with that id all are), the others are revisits that refer to
    it. Records without a page_id are responses where no other has one."""
    slim = records.where("problem IS NULL AND n_payload >= %d" % least)
    firsts = slim.groupBy("digest").agg(F.max_by(F.struct("page_id", "rid", "url", "date"), "page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    firsts = firsts.select(F.col("digest").alias("d"), "first")
    found = slim.join(firsts, F.col("digest") == F.col("d")).where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    return found.groupBy(F.col("arc_id").alias("id")).agg(F.collect_set(F.struct("place", F.col("first.rid").alias("rid"), F.col("first.url").alias("url"), F.col("first.date").alias("date"))).alias("revisits"))


#: Bytes of a WARC file, about; a longer record makes a longer one.
ARCHIVE_BYTES = 16 << 20


def convert(arcs: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """WARC archives (``content``, a row each) of legacy archives; what is damaged in these is left
    out (see ``problems``), what stands before and behind is not."""
    scratch = scratch or Scratch(arcs.sparkSession, "convert")
    to = revisits(scratch.written(from_arc(arcs), "records"), least).withColumnRenamed("id", "i")
    every = arcs.select("arc", F.sha1("arc").alias("id")).join(to, F.col("id") == F.col("i"), "left").select("arc", "revisits")

    def converted(r: dict, head: bytes, d: str, rid: str, to: dict | None) -> bytes:
        fields = {"WARC-Date": iso(r["date"]), "WARC-Target-URI": r["url"], "WARC-Payload-Digest": f"sha1:{d}"}
        kind, block = "response", r["block"]
        if to:
            kind, block = "revisit", head
            fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": to["rid"], "WARC-Refers-To-Target-URI": to["url"], "WARC-Refers-To-Date": iso(to["date"])}
        fields |= {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response" if block.startswith(b"HTTP/") else r["mime"]}
        return member(warc_record(kind, rid, fields, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[bytes] = []
        held = 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["content"])
        for batch in batches:
            for i in range(batch.num_rows):
                to = {x["place"]: x for x in batch.column("revisits")[i].as_py() or []}
                for place, (r, head, _, _, d, rid) in enumerate(parsed(zlib.decompress(batch.column("arc")[i].as_py()))):
                    if not out:
                        out.append(member(info_record(r["date"], rid)))
                    out.append(converted(r, head, d, rid, to.get(place)))
                    held += len(out[-1])
                    if held >= archive_bytes:
                        yield made()
                        out, held = [], 0
        if out:
            yield made()

    return every.mapInArrow(giving_back(run), "content binary")


def write_archives(archives: DataFrame, path: str) -> None:
    """Each row's ``content`` as a file .warc.gz under ``path``.

    Through Spark's text writer, which writes a row's bytes as they are and then a separator: a
    zero byte, which is what a gzip member of less than 16 MB ends in. So the last byte of each
    file is left to it, after an empty member where the last one is longer. Its commit protocol
    leaves no part of a lost task's files; only then are they given their names."""
    empty = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
    whole = F.when(F.substring("content", -1, 1) == F.lit(b"\0"), F.col("content")).otherwise(F.concat("content", F.lit(empty)))
    rows = archives.select(whole.alias("c")).select(F.expr("CAST(substring(c, 1, octet_length(c) - 1) AS STRING)").alias("value"))
    rows.write.mode("overwrite").option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    spark = archives.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.endswith(".txt") and status.getLen():
            fs.rename(status.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, name.removesuffix(".txt") + ".warc.gz"))
        elif name.endswith(".txt"):
            fs.delete(status.getPath(), False)  # of a task without rows


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, rid string, to_rid string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """What stands in the archives under a folder, whose descriptions are passed over. Digests of
    payloads that are there are made from them and must agree with the records' own."""
    files = spark.read.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for head, block in read_warc(inflated(batch.column("content")[i].as_py())):
                    kind = header(head, "WARC-Type")
                    if kind == "warcinfo":
                        continue
                    http, payload = split_http(block)
                    said = (header(head, "WARC-Payload-Digest") or "").removeprefix("sha1:")
                    if kind == "response" and digest(payload) != said:
                        raise ValueError(f"the payload of {header(head, 'WARC-Record-ID')} has another digest")
                    n = len(payload) if kind == "response" else int(header(http, "Content-Length") or 0)
                    k = header(http, "X-Page-Id")
                    rows.append((int(k) if k else None, n, said, kind, header(head, "WARC-Record-ID"), header(head, "WARC-Refers-To")))
                if rows:
                    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], [f.split()[0] for f in READ.split(", ")])

    return files.mapInArrow(giving_back(run), READ)


def round_trip(spark: SparkSession, pages: DataFrame, date: str = "20240101000000", least: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """The pages as legacy archives, these as WARC archives, and what is read from those.

    A null html is an empty payload; a null url is written as none; null ids stay null. Equal
    payloads, empty ones too, are revisits of the one with the largest id. An empty table gives
    no rows; other columns are ignored."""
    scratch = scratch or Scratch(spark, "warc")
    arcs = scratch.written(to_arc(pages, date), "arc")
    write_archives(convert(arcs, least, scratch=scratch), scratch.path("warc"))
    scratch.release()
    found = scratch.written(read_archives(spark, scratch.path("warc")), "read")
    to = found.where("record_type = 'response'").groupBy(F.col("rid").alias("r")).agg(F.max("page_id").alias("refers_to"))
    own = found.where("record_type = 'revisit'").join(to, F.col("to_rid") == F.col("r"))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(cols).unionByName(found.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("bigint")).select(cols))
