"""WARC archives compressed with a dictionary of their own, and their reader.

A Zstandard dictionary is trained on records of payloads drawn by their digests from the whole
table, about SAMPLE_BYTES of them (every payload, if there are no more). Each task writes one
archive: the dictionary in a leading skippable frame, a warcinfo record, and every record as a frame of
its own compressed with it, so a reader can start at any record once it has the dictionary. Where the sample
is too small to train on, the dictionary is the sample's content itself. Of records with
equal payloads (by SHA-1) the one with the smallest page_id is a response that holds the payload; the
others are revisits that refer to it and hold the HTTP headers alone.

Only files that the written manifest names count, so a task that runs again leaves no record
twice. Reading checks every response against its digest. Defined results: null html is
an empty payload; a null url is written as ``urn:tessera:none``; rows that repeat the smallest
page_id of their payload are all responses (a record's id is made of page_id and digest, so rows equal
in both have equal ones); rows with a null page_id are revisits of their
payload's smallest page_id, or responses if it has none; very long payloads are records as others are; of
equal page_ids the least url stands for the response; an empty table gives no archive; other
columns of the input, whatever their names, are not read; payloads of under ``least_bytes`` are always responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, map_arrow, new_path, open_fs, written

SKIPPABLE = 0x184D2A5D  # the magic number of a frame with a dictionary
SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 2 << 20, 1 << 15, 3
PIECE = 1 << 16  # of a long payload in the sample, from a place that its digest tells
#: Up to so many digests that several pages share (about 150 bytes each) are broadcast; more are joined.
BROADCAST_DIGESTS = 50_000
DATE = "1970-01-01T00:00:00Z"  # pages have no time of their own
ID = "urn:tessera:page:"


def _rows(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))


def digests(pages: DataFrame) -> DataFrame:
    """digest, bytes, number of pages and first (page_id and url of the response) of every payload."""
    return _rows(pages).groupBy("digest").agg(F.max(F.octet_length("html")).alias("bytes"), F.count("*").alias("pages"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))


def roles(pages: DataFrame, payloads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and, for revisits, first (page_id and url of the response); ``payloads``: written digests."""
    shared = payloads.where("pages > 1").select("digest", "first")
    if shared.count() <= BROADCAST_DIGESTS:
        shared = F.broadcast(shared)
    again = (F.octet_length("html") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return _rows(pages).join(shared, "digest", "left").select("page_id", "url", "html", F.when(again, F.col("first.page_id")).alias("first_id"), F.when(again, F.col("first.url")).alias("first_url"))


def dictionary(pages: DataFrame, payloads: DataFrame) -> bytes:
    """A dictionary from records of the payloads whose digests fall under a bound."""
    total = payloads.agg(F.sum(F.least("bytes", F.lit(PIECE)) + 300)).first()[0] or 0  # about what their records take
    if not total:
        return b""
    draw = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("double") / (1 << 48)
    chosen = _rows(pages).where(draw < SAMPLE_BYTES / total)
    begin = F.greatest(F.lit(1), (draw * (F.length("html") - PIECE)).cast("int"))
    rows = chosen.groupBy("digest").agg(F.min(F.struct("page_id", "url", F.substring("html", begin, F.lit(PIECE)).alias("html"))).alias("x")).select("x.*")
    records_ = sorted(record(r.page_id or 0, r.url, r.html, None, None) for r in rows.collect())  # about SAMPLE_BYTES
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, records_)) // 8)), records_).as_bytes()
    except zstandard.ZstdError:  # too few records to learn from
        return b"".join(records_)[-DICTIONARY_BYTES:]


def record(page_id: int | None, url: str | None, html: str, first_id: int | None, first_url: str | None) -> bytes:
    payload = html.encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first_id is not None else http + payload
    own = f"{ID}{page_id}:{digest}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    clean = lambda u: "urn:tessera:none" if u is None else u.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first_id is None else 'revisit'}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if first_id is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{first_id}:{digest}>", f"WARC-Refers-To-Target-URI: {clean(first_url)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def information() -> bytes:
    """The record at the head of an archive."""
    block = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class Archive:
    """Writes one archive."""

    def __init__(self, stream, dictionary: bytes):
        self.stream, self.n = stream, 0
        stream.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        stream.write(self.compressor.compress(information()))

    def add(self, raw: bytes) -> None:
        self.n += 1
        self.stream.write(self.compressor.compress(raw))


def write_archives(pages: DataFrame, to: str | None = None, least_bytes: int = 0) -> list[dict]:
    """Writes the archives; returns path and number of records (without the first) of each."""
    to = to or new_path(pages.sparkSession, "warc")
    payloads = written(digests(pages), "digests")
    learned = dictionary(pages, payloads)

    def start():
        fs, folder = open_fs(to)
        name = f"{uuid.uuid4().hex}.warc.zst"
        opened: list[Archive] = []

        def make(batch):
            if not opened:
                fs.create_dir(folder, recursive=True)
                opened.append(Archive(fs.open_output_stream(f"{folder}/{name}"), learned))
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id", "first_url"))):
                opened[0].add(record(*row))

        def finish():
            if not opened:
                return None
            opened[0].stream.close()
            return [[f"{to}/{name}"], [opened[0].n]]

        make.finish = finish
        return make

    manifest = written(map_arrow(roles(pages, payloads, least_bytes), "path string, records bigint", start, by="html"), "warc-manifest")
    files = [r.asDict() for r in manifest.orderBy("path").collect()]  # a row an archive
    drop_written(manifest, payloads)
    return files


def records(stream, chunk: int = 1 << 15):
    """The uncompressed records of an archive's stream, one after another."""
    head = stream.read(8)
    dictionary, buffer = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        dictionary, buffer = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0])), b""
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        if not buffer and not (buffer := stream.read(chunk)):
            return
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not buffer and not (buffer := stream.read(chunk)):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(buffer))
            buffer = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """Fields and payload (None in revisits) of a record; its digest is checked. A warcinfo record
    has its fields alone."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    out = dict(line.split(": ", 1) for line in lines)
    if out["WARC-Type"] == "warcinfo":
        return out
    http, _, body = rest[: int(out["Content-Length"])].partition(b"\r\n\r\n")
    size = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"]
    digest = out["WARC-Payload-Digest"].removeprefix("sha1:")
    out |= {"bytes": int(size), "digest": digest, "payload": body if out["WARC-Type"] == "response" else None}
    if out["payload"] is not None and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
        raise ValueError(f"payload of {out['WARC-Record-ID']} differs from its digest")
    return out


def _page(urn: str | None) -> int | None:
    urn = (urn or "").strip("<>")
    return int(urn.removeprefix(ID).split(":")[0]) if urn.startswith(ID) else None


def read_archives(spark: SparkSession, files: list[dict], payload: bool = False) -> DataFrame:
    """One row a record: page_id, payload_bytes, payload_digest, record_type, refers_to and,
    where asked for, url and payload (null in revisits)."""
    listing = spark.createDataFrame([(i, f["path"], f["records"]) for i, f in enumerate(files)], "i int, path string, records bigint").repartitionById(max(1, len(files)), F.col("i"))
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", url string, payload binary" * payload
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    def run(batches):
        for f in (f for b in batches for f in b.to_pylist()):
            fs, at = open_fs(f["path"])
            rows, n, held = [], 0, 0
            with fs.open_input_stream(at) as stream:
                for raw in records(stream):
                    r = parse(raw)
                    if r["WARC-Type"] == "warcinfo":
                        continue
                    row = [_page(r["WARC-Record-ID"]), r["bytes"], r["digest"], r["WARC-Type"], _page(r.get("WARC-Refers-To"))]
                    if payload:
                        row += [r["WARC-Target-URI"], r["payload"]]
                        held += len(r["payload"] or b"")
                    rows.append(row)
                    n += 1
                    if len(rows) >= 10_000 or held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
            if n != f["records"]:
                raise ValueError(f"{f['path']} has {n} records, not {f['records']}")
            if rows:
                yield batch_of(rows)

    return listing.mapInArrow(run, schema)
