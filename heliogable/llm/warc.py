"""WARC archives of Zstandard frames: writing, and reading with checks.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself plain or one Zstandard frame; then each record is one frame
with that dictionary.  The reader loads the dictionary, decodes one frame for
each record, and checks the version line, headers, Content-Length, the blank
lines at the end and digests; a broken record is reported, and where the frame
itself is broken the archive ends there with a report.

Of records with equal payloads (of at least ``least_bytes``) the one with the
largest page_id is the response; the others are revisits that name it and hold
no payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogable.llm import store

# Fixed values of the formats.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

#: Pages that the dictionary learns from, at most, and bytes of each; its size.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 500, 16_384, 65_536
#: Payloads that are looked up by broadcast, the most frequent ones.
HOT = 1000
#: An archive ends after so many bytes.
ARCHIVE_BYTES = 256 << 20
DATE = "2026-01-01T00:00:00Z"
LEVEL = 3


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _one_line(value: str) -> str:
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A whole record: headers, block, two line ends."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame, with the dictionary compressed."""
    import zstandard

    body = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary) if dictionary else b""
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


class Archive:
    """Records of one archive, read a frame at a time."""

    def __init__(self, source, step: int = 1 << 16):
        import zstandard

        self.source, self.step = source, step
        self.left = self._take(8)
        self.dictionary = b""
        if len(self.left) == 8 and struct.unpack("<I", self.left[:4])[0] == DICTIONARY_MAGIC:
            size = struct.unpack("<I", self.left[4:])[0]
            body = self._take(size)
            if len(body) != size:
                raise ValueError("the dictionary frame is cut off")
            try:
                self.dictionary = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 26) if body[:4] == FRAME_MAGIC else body
            except zstandard.ZstdError as e:
                raise ValueError(f"broken dictionary: {e}") from e
            self.left = b""
        held = zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary else None
        try:
            self.decoder = zstandard.ZstdDecompressor(dict_data=held)
        except zstandard.ZstdError as e:
            raise ValueError(f"broken dictionary: {e}") from e

    def _take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and (more := self.source.read(n - len(out))):
            out += more
        return out

    def frames(self) -> Iterator[bytes]:
        """What each frame holds; ValueError where a frame is broken or cut off."""
        import zstandard

        while True:
            if not self.left:
                self.left = self.source.read(self.step)
                if not self.left:
                    return
            one, out = self.decoder.decompressobj(), []
            try:
                while True:
                    out.append(one.decompress(self.left))
                    if one.eof:
                        self.left = one.unused_data
                        break
                    self.left = self.source.read(self.step)
                    if not self.left:
                        raise ValueError("the last frame is cut off")
            except zstandard.ZstdError as e:
                raise ValueError(f"broken frame: {e}") from e
            yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (names in lower case) and block; ValueError says what is wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("headers don't end")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"not a header: {line[:60]!r}")
        headers[name.lower()] = value.strip()
    if missing := [n for n in REQUIRED if n not in headers]:
        raise ValueError(f"headers missing: {', '.join(missing)}")
    if not headers["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    size = int(headers["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {size}, but the block has {max(0, len(rest) - 4)}")
    said = headers.get("warc-block-digest")
    if said is not None and said != f"sha1:{sha1_base32(block)}":
        raise ValueError("the block's digest is another")
    return headers, block


def read_record(raw: bytes) -> dict:
    """A record's row; ``problem`` is null for a sound one."""
    row = dict.fromkeys(ROW.names)
    try:
        headers, block = parse(raw)
        kind = row["record_type"] = headers["warc-type"]
        row["page_id"] = int(headers["x-page-id"]) if "x-page-id" in headers else None
        row["url"], row["record_id"] = headers.get("warc-target-uri"), headers["warc-record-id"]
        row["refers_to"] = int(headers["x-refers-to-page-id"]) if "x-refers-to-page-id" in headers else None
        said = headers.get("warc-payload-digest", "")
        if kind not in ("response", "revisit"):
            return row
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found:
            raise ValueError("no end of the HTTP headers")
        sizes = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
        size = int(sizes[0]) if sizes else len(payload)
        if kind == "response":
            if size != len(payload):
                raise ValueError(f"the HTTP length is {size}, but the payload has {len(payload)}")
            digest = sha1_base32(payload)
            if said not in ("", f"sha1:{digest}"):
                raise ValueError("the payload's digest is another")
            row["payload"] = payload
        else:
            if "warc-refers-to" not in headers or not said.startswith("sha1:"):
                raise ValueError("a revisit names no record or digest")
            digest = said[5:]
        row["payload_bytes"], row["payload_digest"] = size, digest
    except ValueError as e:
        row["problem"] = str(e)
    return row


ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())])
_LISTED = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def train(samples: list[bytes]) -> bytes:
    """A dictionary from some payloads; none where they are too few to learn from."""
    import zstandard

    if len(samples) < 20:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record for each page; returns the table of archives (path, records, bytes).

    A null html is an empty payload.  A null url has no target header.  A null
    id is smaller than all others.  Where several rows have the largest id of a
    payload, all are responses.  Payloads under ``least_bytes`` are all
    responses.  An empty table makes no archive.  Other columns are not read.
    """
    spark = pages.sparkSession
    place = store.folder(spark, "warc")
    html = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    # Only digests and ids are counted; a payload that a third of the pages have is one row a task here.
    found = store.keep(rows.groupBy(F.sha1("payload").alias("of")).agg(F.max("page_id").alias("last"), F.count("*").alias("n")), f"{place}/payloads")
    # The smallest digests: the same pages in every run.
    some = rows.filter(F.octet_length("payload") > 0).select(F.sha1("payload").alias("of"), F.substring("payload", 1, SAMPLE_BYTES).alias("head"))
    sample = [r["head"] for r in some.orderBy("of", "head").limit(SAMPLE_PAGES).collect()]
    dictionary = train([bytes(x) for x in sample])
    # Pages whose payload is there once are responses in any case; the rest look up the largest id.  The most frequent
    # payloads are looked up where the pages are; of the others none holds a large share, so they can move by digest.
    again = found.filter("n > 1")
    hot = again.orderBy(F.desc("n"), "of").limit(HOT).select("of", F.col("last").alias("hot_last"), F.lit(True).alias("hot"))
    joined = rows.withColumn("of", F.sha1("payload")).join(F.broadcast(hot), "of", "left")
    joined = joined.withColumn("of", F.when(F.col("hot"), F.xxhash64("page_id", "url").cast("string")).otherwise(F.col("of")))
    joined = joined.join(again.join(F.broadcast(hot), "of", "left_anti").select("of", "last"), "of", "left").withColumn("last", F.coalesce("hot_last", "last"))
    revisit = (F.octet_length("payload") >= least_bytes) & F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=True)
        rows = (r for b in batches for r in b.to_pylist())
        row = next(rows, None)
        while row is not None:
            path, n, size = f"{place}/archives/{uuid.uuid4().hex}.warc.zst", 0, 0
            with store.create(path) as out:
                out.write(dictionary_frame(dictionary))
                while row is not None and size < ARCHIVE_BYTES:
                    payload = row["payload"]
                    frame = pack.compress(record(row["page_id"], row["url"], payload, sha1_base32(payload), row["last"], row["revisit"]))
                    out.write(frame)
                    n, size = n + 1, size + len(frame)
                    row = next(rows, None)
            yield pa.RecordBatch.from_pylist([{"path": path, "records": n, "bytes": size}], schema=_LISTED)

    out = joined.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("last"))
    return store.keep(out.mapInArrow(run, "path string, records long, bytes long"), f"{place}/list")


def read_warc(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives: page_id, url, record_id, payload_bytes, payload_digest, record_type,
    refers_to, payload (of responses) and problem (null for a sound record; the archive ends at a broken frame)."""
    schema = ROW if with_payload else ROW.remove(ROW.get_field_index("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            with store.opened(path) as f:
                out, size = [], 0
                try:
                    for raw in Archive(f).frames():
                        row = read_record(raw)
                        out.append({k: row[k] for k in schema.names})
                        size += len(raw)
                        if size > 1 << 24:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, size = [], 0
                except ValueError as e:
                    out.append(dict.fromkeys(schema.names) | {"problem": str(e)})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    ddl = "page_id long, url string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload + ", problem string"
    return archives.select("path").repartition(max(1, min(10_000, archives.count()))).mapInArrow(run, ddl)
