"""WARC archives in Zstandard frames: a writer through Spark's file output and a validating reader.

An archive starts with a skippable frame that holds the dictionary (magic ``DICTIONARY``; the dictionary may itself be a
Zstandard frame), then has one frame for each record, so that every record can be read alone.

* Writing. Responses whose payload of at least ``LEAST_BYTES`` another record repeats are decided by one aggregate over
  (digest, length); the record with the largest id keeps the payload, the others revisit it. Tasks compress their rows and
  start a new archive after ``ARCHIVE_BYTES``. Files are written by Spark's text writer, whose commit protocol survives
  lost tasks and executors and which writes to any store that Spark writes to: a frame is a line, the line separator is an
  empty skippable frame, which every Zstandard reader passes over.
* Reading. ``binaryFile`` deals archives to tasks. Frames are found by their block headers, without decoding, and decoded
  one at a time. Checked are: frame structure, dictionary id and checksum, the WARC version, the mandatory header fields,
  the record's Content-Length and its closing CRLF CRLF, block and payload digests, the HTTP length, and what a revisit
  must name. A record that fails is a row with its ``problem``; a frame that cannot be delimited ends its archive.

The dictionary is trained on at most ``SAMPLE_ROWS`` records of at most ``SAMPLE_BYTES`` each, chosen by a hash; it only
makes archives smaller. Where training is impossible (too few records), archives have none. A task holds one archive
(``ARCHIVE_BYTES`` compressed, or one record if that is larger) and one record.

Edge cases: a null html is an empty payload; a null url becomes ``urn:page:<id>``, control characters and spaces in a url
are percent-encoded; rows that share the largest id of equal payloads all are responses, a null id is smaller than any
other (and rows of a group without any id all are responses); an empty table gives no archive and an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.common import BROADCAST_ROWS, Scratch, bounded_bytes, small, tidy

# Magic numbers of the format.
ZSTD = 0xFD2FB528
DICTIONARY = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
SEPARATOR = (0x184D2A50).to_bytes(4, "little") + bytes(4)  # an empty skippable frame; ASCII
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

LEAST_BYTES = 1000
ARCHIVE_BYTES = 8 << 20
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16 << 10, 32 << 10
DATE = "1970-01-01T00:00:00Z"
HOT_COPIES = 1000
LEVEL = 3

RECORDS = ("archive string, offset long, frame_bytes long, record_id string, record_type string, target_uri string, date string, page_id long, "
           "refers_to long, payload_bytes long, payload_digest string, payload binary, problem string")


# ---------------------------------------------------------------- records


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _uri(url: str | None, page: str) -> str:
    if url is None:
        return f"urn:page:{page}"
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record as it stands before compression."""
    page = "-" if page_id is None else str(page_id)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", date),
              ("WARC-Target-URI", _uri(url, page)), ("Content-Type", "application/http;msgtype=response"),
              ("WARC-Payload-Digest", _base32(hashlib.sha1(payload).digest())), ("WARC-Block-Digest", _base32(hashlib.sha1(block).digest()))]
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE), ("WARC-Truncated", "length")]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


class Malformed(ValueError):
    """What is wrong with a frame or record."""


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and out:  # continued
            out[next(reversed(out))] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise Malformed(f"header line without a name: {line[:40]!r}")
        out[name.strip().lower()] = value.strip()
    return lines[0], out


def _digest_of(field: str | None) -> str | None:
    """Hexadecimal SHA-1 of a labelled digest; None where it is another kind."""
    if not field or not field.lower().startswith("sha1:"):
        return None
    try:
        return base64.b32decode(field[5:].upper()).hex()
    except ValueError as bad:
        raise Malformed("digest is no base 32") from bad


def _page(urn: str | None) -> int | None:
    text = (urn or "").strip("<>")
    return int(text[9:]) if text.startswith("urn:page:") and text[9:].lstrip("-").isdigit() else None


def parse(raw: bytes) -> dict:
    """Fields and payload of one record; raises ``Malformed``."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, fields = _fields(head)
    if not gap:
        raise Malformed("header without an end")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise Malformed(f"version {version[:20]!r}")
    for name in MANDATORY:
        if not fields.get(name):
            raise Malformed(f"no {name}")
    if not fields["content-length"].isdigit():
        raise Malformed("content-length is no number")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise Malformed(f"length {length} of {len(rest) - 4} bytes")
    block, kind = rest[:length], fields["warc-type"]
    told = _digest_of(fields.get("warc-block-digest"))
    if told and told != hashlib.sha1(block).hexdigest():
        raise Malformed("block digest")
    payload, size = block, length
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        status, named = _fields(http)
        if not gap or not status.startswith("HTTP/"):
            raise Malformed("no HTTP header")
        size = int(named["content-length"]) if named.get("content-length", "").isdigit() else len(payload)
    told = _digest_of(fields.get("warc-payload-digest"))
    if kind == "revisit":
        if not fields.get("warc-profile") or told is None:
            raise Malformed("revisit without profile or digest")
        if payload:
            raise Malformed("revisit with a payload")
    else:
        if size != len(payload):
            raise Malformed(f"HTTP length {size} of {len(payload)} bytes")
        seen = hashlib.sha1(payload).hexdigest()
        if told not in (None, seen):
            raise Malformed("payload digest")
        told = seen
    return {"record_id": fields["warc-record-id"], "record_type": kind, "target_uri": fields.get("warc-target-uri"), "date": fields["warc-date"],
            "page_id": _page(fields["warc-record-id"]), "refers_to": _page(fields.get("warc-refers-to")), "payload_bytes": size,
            "payload_digest": told, "payload": payload, "problem": None}


# ---------------------------------------------------------------- frames


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame; the dictionary is compressed."""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return DICTIONARY.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def frame_end(data: bytes, at: int) -> int:
    """Where the frame at ``at`` ends, from its block headers."""
    n = len(data)
    if at + 4 > n:
        raise Malformed("truncated frame")
    magic = int.from_bytes(data[at : at + 4], "little")
    if magic in SKIPPABLE:
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    elif magic == ZSTD:
        try:
            head = data[at : at + 18]
            end, checksum = at + zstandard.frame_header_size(head), zstandard.get_frame_parameters(head).has_checksum
        except zstandard.ZstdError as bad:
            raise Malformed(f"frame header: {bad}") from bad
        last = False
        while not last:
            if end + 3 > n:
                raise Malformed("truncated frame")
            block = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
            if kind == 3:
                raise Malformed("reserved block type")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * checksum
    else:
        raise Malformed(f"no frame: magic {magic:08x}")
    if end > n:
        raise Malformed("truncated frame")
    return end


def _dictionary(frame: bytes) -> zstandard.ZstdCompressionDict:
    held = frame[8:]
    if held[:4] == ZSTD.to_bytes(4, "little"):
        held = zstandard.ZstdDecompressor().decompress(held)
    return zstandard.ZstdCompressionDict(held)


def records(data: bytes) -> Iterator[tuple[int, int, dict]]:
    """(offset, frame bytes, record) of one archive; a record that fails has only its ``problem``."""
    at, known, reader = 0, 0, zstandard.ZstdDecompressor()
    while at < len(data):
        try:
            end = frame_end(data, at)
        except Malformed as bad:
            yield at, len(data) - at, {"problem": str(bad)}
            return
        frame, start, at = data[at:end], at, end
        if frame[:4] != ZSTD.to_bytes(4, "little"):
            if int.from_bytes(frame[:4], "little") == DICTIONARY:
                try:
                    if start:
                        raise Malformed("dictionary behind the start")
                    held = _dictionary(frame)
                    known, reader = held.dict_id(), zstandard.ZstdDecompressor(dict_data=held)
                except (Malformed, zstandard.ZstdError, ValueError) as bad:
                    yield start, len(frame), {"problem": f"dictionary: {bad}"}
                    return
            continue
        try:
            asked = zstandard.get_frame_parameters(frame[:18]).dict_id
            if asked not in (0, known):
                raise Malformed(f"dictionary {asked} is not in the archive")
            try:
                sized = zstandard.frame_content_size(frame[:18]) >= 0
                raw = reader.decompress(frame) if sized else reader.decompressobj().decompress(frame)
            except zstandard.ZstdError as bad:
                raise Malformed(f"frame: {bad}") from bad
            yield start, len(frame), parse(raw)
        except Malformed as bad:
            yield start, len(frame), {"problem": str(bad)}


# ---------------------------------------------------------------- Spark


def planned(pages: DataFrame, scratch: Scratch, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows (page_id, url, payload, refers_to, revisit) from pages (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    groups = scratch.pin(rows.where(F.col("size") >= LEAST_BYTES).groupBy("digest", "size")
                         .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keeper IS NOT NULL"))
    if groups.limit(broadcast_rows + 1).count() <= broadcast_rows:
        told = rows.join(F.broadcast(groups.drop("n")), ["digest", "size"], "left")
    else:  # many groups: the few large ones are still broadcast, so that no copied payload loads one task
        hot = small(groups.where(F.col("n") >= HOT_COPIES).select("digest", "size", F.col("keeper").alias("hot")), max(broadcast_rows, 1))
        cold = groups.where(F.col("n") < HOT_COPIES).select(F.col("digest").alias("key"), F.col("size").alias("key_size"), "keeper")
        spread = F.concat(F.lit("hot"), F.xxhash64("page_id", "url").cast("string"))  # matches nothing
        told = rows.join(hot, ["digest", "size"], "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(spread))
        told = told.join(cold.withColumnRenamed("key_size", "size"), ["key", "size"], "left").withColumn("keeper", F.coalesce("hot", "keeper"))
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return told.select("page_id", "url", "payload", F.when(revisit, F.col("keeper")).alias("refers_to"), revisit.alias("revisit"))


def train(pages: DataFrame) -> bytes:
    """Dictionary from a bounded sample of records; empty if there are too few."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit(13), "page_id", "url"), F.lit(1 << 20))
    some = rows.where((draw < int(min(1.0, SAMPLE_ROWS / max(n, 1)) * (1 << 20))) & (F.octet_length("payload") <= SAMPLE_BYTES)).limit(2 * SAMPLE_ROWS)
    samples = sorted(record(r[0], r[1], bytes(r[2]), None, False) for r in some.collect())  # at most 2 * SAMPLE_ROWS * SAMPLE_BYTES
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, level=LEVEL).as_bytes() if len(samples) > 8 else b""
    except zstandard.ZstdError:  # too little or too uniform material
        return b""


def _frames(rows: Iterator[pd.DataFrame], dictionary: bytes, archive_bytes: int) -> Iterator[pd.DataFrame]:
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=True, write_content_size=True)
    first = [dictionary_frame(dictionary)] if dictionary else []
    task, archive, size = TaskContext.get().partitionId(), 0, 0
    seq = 0
    for batch in rows:
        frames, names = [], []
        for page_id, url, payload, refers_to, revisit in zip(*(batch[c] for c in ("page_id", "url", "payload", "refers_to", "revisit")), strict=True):
            if size >= archive_bytes:
                archive, size = archive + 1, 0
            new = [] if size else first
            ids = [None if x is None or x != x else int(x) for x in (page_id, refers_to)]
            for frame in (*new, writer.compress(record(ids[0], url, bytes(payload), ids[1], bool(revisit)))):
                frames.append(frame)
                names.append(f"{task:06d}-{archive:06d}")
                size += len(frame)
        yield pd.DataFrame({"archive": names, "seq": range(seq, seq + len(frames)), "frame": frames})
        seq += len(frames)
    tidy()


def write_archives(rows: DataFrame, path: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives below ``path`` from rows (page_id, url, payload, refers_to, revisit)."""
    bounded_bytes(rows.sparkSession)
    whole = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"), "revisit")
    frames = whole.mapInPandas(lambda it: _frames(it, dictionary, archive_bytes), "archive string, seq long, frame binary")
    lines = frames.sortWithinPartitions("archive", "seq").select("archive", F.col("frame").cast("string").alias("value"))
    lines.write.partitionBy("archive").option("lineSep", SEPARATOR.decode("ascii")).option("compression", "none").text(path)


def _read(rows: Iterator[pd.DataFrame], payloads: bool) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in RECORDS.split(", ")]
    whole = ("offset", "frame_bytes", "page_id", "refers_to", "payload_bytes")
    for batch in rows:
        for path, data in zip(batch["path"], batch["content"], strict=True):
            held, size = [], 0

            def table(held: list[dict]) -> pd.DataFrame:
                df = pd.DataFrame(held, columns=columns, dtype=object)
                return df.assign(**{c: pd.array(df[c].tolist(), "Int64") for c in whole})

            for offset, n, r in records(bytes(data)):
                size += len(r.get("payload", b"")) if payloads else 100
                held.append({**r, "archive": path, "offset": offset, "frame_bytes": n, "payload": r.get("payload") if payloads else None})
                if size >= 4 << 20:
                    yield table(held)
                    held, size = [], 0
            if held:
                yield table(held)
    tidy()


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records (``RECORDS``) of all archives below ``path``; a revisit has the length and digest that it names and no payload."""
    bounded_bytes(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(lambda it: _read(it, payloads), RECORDS)


def with_payloads(read: DataFrame) -> DataFrame:
    """Revisits of ``read_archives`` get the payload of the response that they name; where it is missing or differs in length
    or digest, ``problem`` says so. Revisits are brought together by target first, so a hot response is looked up once."""
    keys = ["refers_to", "payload_digest", "payload_bytes"]
    targets = read.where("record_type = 'revisit'").select(*keys).distinct()
    held = read.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes", F.col("payload").alias("_held"))
    found = targets.join(held.dropDuplicates(keys), keys)  # one row a target
    revisit = F.col("record_type") == "revisit"
    lost = revisit & F.col("problem").isNull() & F.col("_held").isNull()
    return read.join(small(found), keys, "left").select(*[c for c in read.columns if c not in ("payload", "problem")],
                                                        F.when(revisit, F.col("_held")).otherwise(F.col("payload")).alias("payload"),
                                                        F.when(lost, "revisit without its response").otherwise(F.col("problem")).alias("problem"))


def archived(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Write one record for each row of pages (page_id, url, html), then read the archives back (without payloads)."""
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    path = f"{scratch.root}/archives"
    write_archives(planned(pages, scratch), path, train(pages))
    return read_archives(spark, path, payloads=False)


def _kind(column: Column) -> Column:
    return F.when(column.isin("response", "revisit"), column)


def summary(read: DataFrame) -> DataFrame:
    """Per record of pages: page_id, payload_bytes, payload_digest, record_type, refers_to, and what is wrong with it."""
    return read.select("page_id", "payload_bytes", "payload_digest", _kind(F.col("record_type")).alias("record_type"), "refers_to", "problem")


ORACLE = f"""
SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN copy THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN copy THEN keeper END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM (SELECT *, strlen(body) >= {LEAST_BYTES} AND keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper AS copy
      FROM (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages))
"""
