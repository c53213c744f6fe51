"""WARC records in seekable Zstandard bundles.

Writing: payload digests are grouped (partial counts first, so a payload that a third of all
pages share is no hot group); the smallest page_id of a repeated payload of at least
``MIN_REVISIT`` bytes becomes its response record, the others become revisit records without
a body. Every task appends records to frames of about ``FRAME_BYTES`` raw bytes, each an
independent Zstandard frame, and frames to bundles of about ``BUNDLE_BYTES``. A bundle ends in
a seek table: a skippable frame with compressed and raw sizes of all frames and the magic of
the Zstandard seekable format. The index maps a record id to bundle, frame and the offset and
length within the frame.

Bundles are written under a name of their own and the index names only those of successful
attempts, so a retried task leaves at most an unreferenced file.

Reading: the index rows of a bundle frame are read together. A task reads the seek table at the
end of each bundle that it opens, seeks to a frame by the sizes of those before it, and
decompresses that frame alone.

Defined cases: a null html is an empty payload; a very long one is a frame of its own; a null url an empty target; a null page_id
counts after all others; rows that repeat a page_id are separate records,
and repeated rows of the smallest page_id are all responses; an empty table gives no bundles and no rows.
"""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import prepare, shared_dir, stored

MIN_REVISIT = 100
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 26
LEVEL = 3
#: Marked pages (an id, a digest and an id each, some 10 MB in all) that may go to every executor.
BROADCAST_ROWS = 100_000
# Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
LAST = (1 << 63) - 1
INDEX = "page_id long, record_id string, record_type string, refers_to long, bundle string, frame int, raw_start long, raw_length long"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, raw) sizes."""
    body = b"".join(struct.pack("<II", c, r) for c, r in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int]]:
    """(compressed, raw) sizes from the end of a bundle."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEK_MAGIC or flags:
        raise ValueError("no seek table at the end of the bundle")
    return [struct.unpack_from("<II", data, len(data) - 9 - 8 * (n - i)) for i in range(n)]


class Bundle:
    """An opened bundle: frames are found by the seek table at its end."""

    def __init__(self, files, path: str):
        self.source = files.open_input_file(path)
        size = self.source.size()
        self.source.seek(size - 9)
        n = struct.unpack("<IBI", self.source.read(9))[0]
        self.source.seek(max(0, size - 9 - 8 * n))
        sizes = [c for c, _ in read_seek_table(self.source.read())]
        self.places = [0, *itertools.accumulate(sizes)]

    def frame(self, k: int) -> bytes:
        """The raw bytes of a frame."""
        self.source.seek(self.places[k])
        return zstandard.ZstdDecompressor().decompress(self.source.read(self.places[k + 1] - self.places[k]))

    def close(self) -> None:
        self.source.close()


def record(record_id: str, kind: str, url: str, digest: str, size: int, refers_to: str, payload: bytes) -> bytes:
    """One WARC/1.1 record; the body is the payload, and a revisit has none."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Target-URI: {' '.join(url.split())}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join([*head, "", ""]).encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    return fields, rest[: int(fields["Content-Length"])]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _written(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _store(folder)
        packer = zstandard.ZstdCompressor(level=LEVEL)
        names = [x.split()[0] for x in INDEX.split(", ")]
        types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in INDEX.split(", ")]
        bundle, frames, raw, rows, done, at, sizes = None, [], [], [], [], 0, 0

        def end_frame() -> None:
            nonlocal raw, rows, at, sizes
            data = packer.compress(b"".join(raw))
            bundle[1].write(data)
            done.extend((*r[:4], bundle[0], len(frames), *r[4:]) for r in rows)
            frames.append((len(data), sizes))
            at += len(data)
            raw, rows, sizes = [], [], 0

        def end_bundle() -> pa.RecordBatch:
            nonlocal bundle, frames, done, at
            if raw:
                end_frame()
            bundle[1].write(seek_table(frames))
            bundle[1].close()
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            bundle, frames, done, at = None, [], [], 0
            return out

        for batch in batches:
            for page, url, html, digest, size, first, dup in zip(*(batch.column(i) for i in range(7)), strict=True):
                page, first = page.as_py(), first.as_py()
                payload = b"" if dup.as_py() else html.as_py()
                record_id, kind = uuid.uuid4().hex, "revisit" if dup.as_py() else "response"
                refers = (None if first == LAST else first) if dup.as_py() else None
                data = record(record_id, kind, url.as_py(), digest.as_py(), size.as_py(), "" if refers is None else str(refers), payload)
                if bundle is None:
                    name = f"{base}/{uuid.uuid4().hex}.warc.zst"
                    bundle = (name, files.open_output_stream(name, compression=None))
                rows.append((page, record_id, kind, refers, sizes, len(data)))
                raw.append(data)
                sizes += len(data)
                if sizes >= frame_bytes:
                    end_frame()
                    if at >= bundle_bytes:
                        yield end_bundle()
        if bundle is not None:
            yield end_bundle()

    return run


def write_bundles(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> tuple[str, DataFrame]:
    """Write all pages; gives the folder of the bundles and the index of their records."""
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or shared_dir(spark, "warc")
    files, base = _store(folder)
    files.create_dir(base, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    rows = rows.withColumn("order", F.coalesce("page_id", F.lit(LAST)))
    # repeats are marked on ids and digests alone; the pages stay where they are if the marks are few
    long = rows.filter(F.col("size") >= MIN_REVISIT).select("order", "digest")
    firsts = stored(long.groupBy("digest").agg(F.min("order").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "repeated")
    marks = stored(long.distinct().join(firsts, "digest"), "marks")
    if marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    ready = rows.join(marks, ["order", "digest"], "left").select("page_id", "url", "html", "digest", "size", "first", F.coalesce(F.col("first") < F.col("order"), F.lit(False)).alias("dup"))
    return folder, stored(ready.mapInArrow(_written(folder, frame_bytes, bundle_bytes), INDEX), "warc-index")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _store(folder)
        opened: dict[str, Bundle] = {}
        now, raw = None, b""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["bundle"], row["frame"]) != now:
                    if row["bundle"] not in opened:
                        for f in opened.values():
                            f.close()
                        opened = {row["bundle"]: Bundle(files, row["bundle"])}
                    raw = opened[row["bundle"]].frame(row["frame"])
                    now = (row["bundle"], row["frame"])
                fields, body = parse(raw[row["raw_start"]:row["raw_start"] + row["raw_length"]])
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                if fields["WARC-Record-ID"] != f"<urn:page:{row['record_id']}>":
                    raise ValueError(f"{row['bundle']}: another record stands at this place")
                if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(fields["X-Payload-Length"])):
                    raise ValueError(f"{row['bundle']}: a payload does not match its digest")
                refers = fields.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
                out.append((row["page_id"], int(fields["X-Payload-Length"]), digest, kind, int(refers) if refers else None))
            if out:
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        for f in opened.values():
            f.close()

    return run


def read_bundles(folder: str, index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every indexed record.

    Frames, not bundles, are dealt to the tasks, so one large bundle is read by many.
    """
    dealt = index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "raw_start")
    return dealt.mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def fetch(folder: str, index: DataFrame, page_ids: list[int]) -> list[tuple[int, bytes]]:
    """The payloads of a few pages by seeking; a revisit gives that of its response."""
    wanted = index.filter(F.col("page_id").isin(page_ids)).select("page_id", F.coalesce("refers_to", "page_id").alias("at"))
    best = Window.partitionBy("page_id").orderBy(F.col("record_type"))
    places = index.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select(F.col("page_id").alias("at"), "bundle", "frame", "raw_start", "raw_length")
    files, _ = _store(folder)
    out = []
    for r in wanted.join(places, "at").collect():
        with contextlib.closing(Bundle(files, r["bundle"])) as bundle:
            raw = bundle.frame(r["frame"])
        out.append((r["page_id"], parse(raw[r["raw_start"]:r["raw_start"] + r["raw_length"]])[1]))
    return out
