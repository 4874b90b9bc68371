"""Web archives as seekable Zstandard bundles.

Records are grouped into frames that can be decompressed alone; each bundle ends with a seek table in a
skippable frame. The manifest maps every record id to its bundle, the place of its frame in the file and
the record's offset inside the frame, so that one record costs one frame. Of equal payloads of at least
``REVISIT_BYTES`` bytes the one with the smallest page id is stored as a response; the others are revisit
records that name it. Bundles go to the shared folder of the session through pyarrow's file systems; a
task that runs again writes files of its own and the manifest names only those of the finished attempt.

Defined cases: null html is an empty payload; rows equal in page id and payload are each what the first is
(all are responses if they have the smallest page id); a null page id counts as larger than any other; a
null url has no target line; an empty table gives an empty archive; other columns are not stored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.texts import slices
from linkloom.runtime import cut, scratch_root

REVISIT_BYTES = 100
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "record_id string, path string, frame_at long, frame_bytes long, frame_size long, record_at long, record_bytes long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    name = record.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def _clean(url: str) -> str:
    return "".join(c if c > " " else "%{:02X}".format(ord(c)) for c in url)


def build(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, header block and content."""
    kind = "revisit" if revisit else "response"
    head = HTTP_HEAD + b"Content-Length: %d\r\n\r\n" % len(payload)
    content = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
             "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines.append(f"Content-Length: {len(content)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, content and end of the record at ``at``."""
    split = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:split].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a record")
    fields = dict(line.split(": ", 1) for line in lines)
    end = split + 4 + int(fields["Content-Length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, data[split + 4:end], end + 4


class Bundle:
    """Writer of one file; keeps only the open frame and the seek table in memory."""

    def __init__(self, path: str, level: int = LEVEL):
        import zstandard

        self.path, self.packer = path, zstandard.ZstdCompressor(level=level)
        files, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
            pyarrow.fs.LocalFileSystem(), path)
        files.create_dir(name.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(name, compression=None)
        self.frame: list[bytes] = []
        self.rows: list[tuple] = []
        self.waiting: list[tuple[str, int, int]] = []
        self.open_bytes = self.at = self.raw = 0
        self.table: list[tuple[int, int]] = []

    def add(self, record: str, data: bytes) -> None:
        if self.frame and self.open_bytes + len(data) > FRAME_BYTES:
            self.end_frame()
        self.waiting.append((record, self.open_bytes, len(data)))
        self.frame.append(data)
        self.open_bytes += len(data)
        self.raw += len(data)

    def end_frame(self) -> None:
        packed = self.packer.compress(b"".join(self.frame))
        self.out.write(packed)
        self.rows += [(r, self.path, self.at, len(packed), self.open_bytes, a, n) for r, a, n in self.waiting]
        self.table.append((len(packed), self.open_bytes))
        self.at += len(packed)
        self.frame, self.waiting, self.open_bytes = [], [], 0

    def close(self) -> list[tuple]:
        if self.frame:
            self.end_frame()
        entries = b"".join(struct.pack("<II", *t) for t in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        return self.rows


def _open(path: str):
    files, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        pyarrow.fs.LocalFileSystem(), path)
    return files.open_input_file(name)


def seek_table(source) -> list[tuple[int, int, int]]:
    """(place, packed bytes, bytes) of every frame, from the end of an open file."""
    size = source.size()
    source.seek(size - 9)
    frames, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("the bundle has no seek table")
    source.seek(size - 9 - 8 * frames)
    numbers = struct.unpack(f"<{2 * frames}I", source.read(8 * frames))
    out, at = [], 0
    for packed, raw in zip(numbers[::2], numbers[1::2]):
        out.append((at, packed, raw))
        at += packed
    return out


def frames_of(path: str) -> Iterator[bytes]:
    """Contents of a bundle's frames, one at a time."""
    import zstandard

    with _open(path) as source:
        unpack = zstandard.ZstdDecompressor()
        for at, packed, raw in seek_table(source):
            source.seek(at)
            yield unpack.decompress(source.read(packed), max_output_size=raw)


def read_record(path: str, frame_at: int, frame_bytes: int, frame_size: int, record_at: int) -> tuple[dict[str, str], bytes]:
    """One record by its manifest row, reading one frame."""
    import zstandard

    with _open(path) as source:
        source.seek(frame_at)
        data = zstandard.ZstdDecompressor().decompress(source.read(frame_bytes), max_output_size=frame_size)
    return parse(data, record_at)[:2]


def write(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and return the manifest, one row per record."""
    root = f"{scratch_root(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    large = F.octet_length("text") >= REVISIT_BYTES
    shared = rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = shared.filter("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("of"), "first")
    rows = rows.join(shared, F.col("digest") == F.col("of"), "left")
    rows = rows.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))

    def store(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name, made, bundle = f"{root}/bundle-{task.partitionId():06d}-{task.taskAttemptId()}", 0, None

        def end():
            kinds = ["record_id", "path", "frame_at", "frame_bytes", "frame_size", "record_at", "record_bytes"]
            return pa.RecordBatch.from_pydict(dict(zip(kinds, map(list, zip(*bundle.close())))))

        for batch in batches:
            for part in slices(batch):
                for page, url, text, digest, first, again in zip(*(part.column(c).to_pylist() for c in (
                        "page_id", "url", "text", "digest", "first", "revisit"))):
                    if bundle is None:
                        bundle, made = Bundle(f"{name}-{made:04d}.warc.zst"), made + 1
                    bundle.add(record_id(page), build(page, url, text.encode(), digest, first, again))
                    if bundle.raw >= BUNDLE_BYTES:
                        yield end()
                        bundle = None
        if bundle is not None:
            yield end()

    return cut(rows.select("page_id", "url", "text", "digest", "first", "revisit").mapInArrow(store, MANIFEST))


def read(manifest: DataFrame) -> DataFrame:
    """Read every bundle of the manifest back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest is computed from its payload and must equal the stored one; a revisit takes both
    from the response it names. A bundle with other records than the manifest's is an error."""
    bundles = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("records"))
    bundles = bundles.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2), "path")

    def load(batches):
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                seen = 0
                for data in frames_of(path):
                    at, rows = 0, []
                    while at < len(data):
                        fields, content, at = parse(data, at)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        payload = content[content.index(b"\r\n\r\n") + 4:]
                        response = fields["WARC-Type"] == "response"
                        if response and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload does not have its digest")
                        refers = fields.get("WARC-Refers-To")
                        rows.append((page_of(fields["WARC-Record-ID"]), len(payload) if response else None, digest,
                                     fields["WARC-Type"], page_of(refers) if refers else None))
                    seen += len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                if seen != expected:
                    raise ValueError(f"{path} holds {seen} records, the manifest {expected}")

    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    rows = cut(bundles.mapInArrow(load, kind))
    named = rows.filter("record_type = 'revisit'").select(F.col("refers_to").alias("r"), F.col("payload_digest").alias("d")).distinct()
    sizes = rows.filter("record_type = 'response'").join(named, (F.col("page_id") == F.col("r")) & (F.col("payload_digest") == F.col("d")))
    sizes = sizes.groupBy("r", "d").agg(F.max("payload_bytes").alias("bytes"))
    return rows.join(sizes, (F.col("refers_to") == F.col("r")) & (F.col("payload_digest") == F.col("d")), "left").select(
        "page_id", F.coalesce("payload_bytes", "bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""
