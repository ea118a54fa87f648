"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader by offset.

Writing takes two passes over files, none over rows that must meet:

1. each task writes its pages as response records into one monolithic file, a single
   gzip stream, and returns a line per record: file, position, digest, size;
2. the lines alone are grouped by payload digest, to find what each record revisits;
3. the normaliser takes one monolithic file at a time, inflates its stream once, and
   rewrites every record as a gzip member of its own (repeats as revisit records
   without payload), with a sidecar index of offsets beside the new file.

Files are named by task and written under another name first, so a repeated task
replaces its file whole. They go through pyarrow's file systems to the shared folder,
wherever that is.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.session import attach, cut, remove, shared_folder, small_batches, table

#: Bytes read from a file at a time.
PIECE = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def clean_header(value: str) -> str:
    """A header's value on one line."""
    return re.sub(r"[\r\n]+", " ", value)


def response_record(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {"WARC-Type": "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE, "WARC-Target-URI": clean_header(url or ""), "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-ID": "" if page_id is None else str(page_id), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(http) + len(payload))}
    return serialised(head, http + payload)


def serialised(head: dict[str, str], block: bytes) -> bytes:
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def revisit_of(head: dict[str, str], block: bytes, refers_to: int | None) -> bytes:
    """The revisit record of a response: its HTTP head without the payload, which says the payload's length."""
    http = block[: block.index(b"\r\n\r\n") + 4]
    kept = {k: v for k, v in head.items() if k != "Content-Length"} | {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-ID": "" if refers_to is None else str(refers_to), "WARC-Truncated": "length", "Content-Length": str(len(http))}
    return serialised(kept, http)


class Inflater:
    """Reads a gzip file once, as one stream, whatever its members; gives exact numbers of bytes or lines."""

    def __init__(self, source):
        self.source, self.held, self.inflate, self.at = source, bytearray(), zlib.decompressobj(31), 0

    def _more(self) -> bool:
        while True:
            tail = self.inflate.unused_data
            if self.inflate.eof:
                if not tail and not (tail := self.source.read(PIECE)):
                    return False
                self.inflate = zlib.decompressobj(31)
                piece = tail
            else:
                piece = self.source.read(PIECE)
                if not piece:
                    return False
            out = self.inflate.decompress(piece)
            if out:
                del self.held[: self.at]
                self.at = 0
                self.held += out
                return True

    def line(self) -> bytes:
        """Through the next line feed; empty at the end."""
        found = self.held.find(b"\n", self.at)
        while found < 0:
            if not self._more():
                found = len(self.held) - 1
                break
            found = self.held.find(b"\n", self.at)
        out = bytes(self.held[self.at : found + 1])
        self.at = found + 1
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self._more():
                raise EOFError(f"{n} bytes expected, the stream ends after {len(self.held) - self.at}")
        out = bytes(self.held[self.at : self.at + n])
        self.at += n
        return out


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open gzip file."""
    stream = Inflater(source)
    while line := stream.line():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.line()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip()] = value.strip()
        yield head, stream.exactly(int(head["Content-Length"]))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _gzip_pieces(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_monolithic(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write pages (page_id, url, html) as files of one gzip stream each; a line per record: file, position, page_id, digest, payload_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name = f"mono-{TaskContext.get().partitionId():06d}.warc.gz"
        out, position = None, 0
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    own = f"{root}/.{name}.{uuid.uuid4().hex}"
                    out, squeeze = fs.open_output_stream(own, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                payload = (html or "").encode()
                digest = sha1_base32(payload)
                out.write(squeeze.compress(response_record(page_id, url, payload, digest)))
                for column, x in zip(rows, (position, page_id, digest, len(payload))):
                    column.append(x)
                position += 1
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows[0]), pa.string()), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64())], ["file", "position", "page_id", "digest", "payload_bytes"])
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            fs.move(own, f"{root}/{name}")

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, "file string, position long, page_id long, digest string, payload_bytes long")


def normalise(source, target, decide, level: int = 6) -> Iterator[dict]:
    """Rewrite an open monolithic gzip file record by record into target, each as a member of its own.

    decide(position) is None to keep a record as it is, or (page_id,) of the record that
    it revisits. Yields the sidecar's lines: position, offset, length, type.
    """
    offset = 0
    for position, (head, block) in enumerate(records(source)):
        revisits = decide(position)
        data = serialised(head, block) if revisits is None else revisit_of(head, block, revisits[0])
        member = _gzip_pieces(data, level)
        target.write(member)
        yield {"position": position, "offset": offset, "length": len(member), "type": head["WARC-Type"] if revisits is None else "revisit"}
        offset += len(member)


def normalise_files(decisions: DataFrame, folder: str, target: str) -> DataFrame:
    """Normalise each file named in decisions (file, position, refers_to of revisits); a line per record: file, position, offset, length.

    decisions must be partitioned and sorted by file and position. The sidecar
    file.index.jsonl beside each new file has the same lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        new_root = file_system(target)[1]

        def one(name: str, revisits: dict[int, tuple]) -> pa.RecordBatch:
            fs.create_dir(new_root, recursive=True)
            new = name.replace("mono-", "part-", 1)
            own, side = (f"{new_root}/.{new}{end}.{uuid.uuid4().hex}" for end in ("", ".index.jsonl"))
            with fs.open_input_stream(f"{root}/{name}", compression=None) as source, fs.open_output_stream(own, compression=None) as out, fs.open_output_stream(side, compression=None) as index:
                lines = []
                for line in normalise(source, out, revisits.get):
                    index.write((json.dumps(line) + "\n").encode())
                    lines.append((line["position"], line["offset"], line["length"]))
            fs.move(own, f"{new_root}/{new}")
            fs.move(side, f"{new_root}/{new}.index.jsonl")
            return pa.RecordBatch.from_arrays([pa.array([new] * len(lines), pa.string()), *(pa.array([x[i] for x in lines], pa.int64()) for i in range(3))], ["file", "position", "offset", "length"])

        current, revisits = None, {}
        for batch in batches:  # a file's lines follow one another
            for name, position, repeat, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if name != current:
                    if current is not None:
                        yield one(current, revisits)
                    current, revisits = name, {}
                if repeat:
                    revisits[position] = (refers_to,)
        if current is not None:
            yield one(current, revisits)

    return decisions.select("file", "position", "repeat", "refers_to").mapInArrow(run, "file string, position long, offset long, length long")


def sidecar_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecars of the archives under folder: file, position, offset, length. At least one must be there."""
    lines = spark.read.schema("position long, offset long, length long").json(f"{folder}/*.index.jsonl")
    return lines.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.index\.jsonl$", 1).alias("file"), "position", "offset", "length")


def read_back(index: DataFrame, folder: str, files: int | None = None) -> DataFrame:
    """Read every record of index (file, position, offset, length) by its offset, in a task for each of files.

    -> page_id, payload_bytes, payload_digest, record_type, refers_to, url, and payload
    (null for revisits). A response's digest and length are taken from its payload; a
    digest that its header contradicts raises an error. A revisit has no payload: its
    digest and length are those that its headers say.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name, held = None, None
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    if held is not None:
                        held.close()
                    name, held = file, fs.open_input_file(f"{root}/{file}")
                held.seek(offset)
                head, block = next(records(pa.BufferReader(held.read(length))))
                http, _, payload = block.partition(b"\r\n\r\n")
                said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response":
                    size, digest = len(payload), sha1_base32(payload)
                    if digest != said:
                        raise ValueError(f"{file}, offset {offset}: the payload isn't what its digest says")
                else:
                    size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), said
                number = lambda x: int(x) if x else None
                revisit = head["WARC-Type"] == "revisit"
                for column, x in zip(columns, (number(head["X-Page-ID"]), size, digest, head["WARC-Type"], number(head.get("X-Refers-To-Page-ID")), head["WARC-Target-URI"], None if revisit else payload)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
        if held is not None:
            held.close()

    slim = index.select("file", "offset", "length")
    if files:
        slim = slim.repartition(files, "file").sortWithinPartitions("file", "offset")
    return slim.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def archive(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as normalised archives under folder; the index: file, position, offset, length.

    Of records with equal payloads of at least `least` bytes, that with the smallest
    page_id is a response and the others revisit it; smaller payloads are all responses.
    A null html counts as empty, a null url is written empty. Of rows repeated with
    page_id and payload the first written is the response. A null page_id is larger than
    any other. No pages give no files.
    """
    spark = pages.sparkSession
    small_batches(spark)
    mono = f"{folder}/monolithic"
    lines = cut(write_monolithic(pages, mono))
    order = F.struct(F.col("page_id").isNull(), F.coalesce("page_id", F.lit(0)), "file", "position")
    groups = cut(lines.groupBy("digest", "payload_bytes").agg(F.count(F.lit(1)).alias("members"), F.min(order).alias("o"), F.min("page_id").alias("refers_to")).filter((F.col("members") > 1) & (F.col("payload_bytes") >= least)).select("digest", "payload_bytes", "members", "refers_to", F.col("o.file").alias("first_file"), F.col("o.position").alias("first_position")))
    decided = attach(lines, groups, ["digest", "payload_bytes"], "members", lines.count())
    repeat = F.col("members").isNotNull() & ~((F.col("file") == F.col("first_file")) & (F.col("position") == F.col("first_position")))
    decided = decided.select("file", "position", repeat.alias("repeat"), "refers_to")
    # a line stands for a whole page, so tasks are counted by files and not by the bytes of lines
    files = lines.select("file").distinct().count()
    return cut(normalise_files(decided.repartition(max(1, files), "file").sortWithinPartitions("file", "position"), mono, folder))


def op8_warc(spark, sf_dir):
    """Every page's record, as read back from the archives it was written to."""
    folder = shared_folder(spark, "warc")
    index = archive(table(spark, sf_dir, "pages"), folder)
    files = index.select("file").distinct().count()
    if files:
        index = sidecar_index(spark, folder)
    found = cut(read_back(index, folder, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove(spark, folder)
    return found




_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * k + 1}, 5))::INT >> {15 - 5 * i}) & 31) + 1, 1)" for k in range(8) for i in range(4))
OP8_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, {_BASE32} AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = min(page_id) OVER w THEN NULL ELSE min(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY payload_digest, payload_bytes)
"""
