"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; each bundle ends in a seek table (a skippable frame of the seekable format,
with its footer), and every record id maps to bundle, frame, and offset and length inside the frame.  Equal payloads are
stored once: later records are revisits that name the first one and carry its digest.

Payloads never travel.  Digests and ids are grouped first, and what repeats is stored as sorted hash arrays; the tasks that read the pages look each
digest up there, write the responses at once and hand on the revisits, which have no payload and are written when the ids of the responses are known.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HashStore, read_bytes, resolve, shard_bits, workspace, write_bytes

# Fixed values of the seekable format: skippable frame, seek table, end of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records in a frame, and of compressed frames in a bundle (one record may go beyond either).
FRAME, BUNDLE = 1 << 18, 32 << 20
#: Revisits of one response that meet in a task.
PART = 50_000
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, record_id string, bundle string, frame int, at long, length long"


def _clean(uri: str) -> str:
    """A uri that stays on its header line."""
    return "".join(c if 0x20 < ord(c) != 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


def record(page_id: int | None, uri: str | None, payload: bytes, size: int, digest: str, date: str, refers_to: tuple[int | None, str, str | None] | None = None) -> tuple[str, bytes]:
    """One WARC/1.1 record, and its id, which no other record has.  refers_to: page id, record id and uri of the response whose payload this one repeats; None for a response."""
    rid = f"urn:uuid:{uuid.uuid4()}"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {date}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        page, first, target = refers_to
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{first}>", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-Id: {page}"]
        if target is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(target)}")
    return rid, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers (names in lower case), HTTP header block, payload of one record; ValueError where it is not one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return headers, http, payload


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class Bundle:
    """Reads frames of a stored bundle by its seek table."""

    def __init__(self, uri: str):
        self.uri = uri
        filesystem, path = resolve(uri)
        size = filesystem.get_file_info(path).size
        n, flags, magic = struct.unpack("<IBI", read_bytes(uri, size - 9, 9))
        if magic != SEEKABLE or flags & 0x80:
            raise ValueError(f"no seek table in {uri}")
        table = np.frombuffer(read_bytes(uri, size - 9 - 8 * n, 8 * n), "<u4").reshape(n, 2).astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.sizes = table[:, 1]
        self.held: tuple[int, bytes] = (-1, b"")

    def frame(self, i: int) -> bytes:
        if self.held[0] != i:
            raw = read_bytes(self.uri, int(self.start[i]), int(self.start[i + 1] - self.start[i]))
            self.held = i, zstandard.ZstdDecompressor().decompress(raw, max_output_size=int(self.sizes[i]))
        return self.held[1]


class Bundles:
    """Packs records into bundles below a folder, and lists where each one is."""

    def __init__(self, folder: str, level: int):
        self.folder, self.packer = folder, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.open_frame: list[bytes] = []
        self.used = 0
        self._new()

    def _new(self) -> None:
        self.name, self.frames, self.table, self.index = f"{self.folder}/{uuid.uuid4().hex}.warc.zst", [], [], []

    def add(self, page_id: int | None, rid: str, data: bytes) -> None:
        self.index.append((page_id, rid, self.name, len(self.frames), self.used, len(data)))
        self.open_frame.append(data)
        self.used += len(data)
        if self.used >= FRAME:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open_frame:
            raw = b"".join(self.open_frame)
            self.frames.append(self.packer.compress(raw))
            self.table.append((len(self.frames[-1]), len(raw)))
            self.open_frame, self.used = [], 0

    @property
    def full(self) -> bool:
        return not self.open_frame and sum(x for x, _ in self.table) >= BUNDLE

    def close(self) -> list[tuple]:
        """Writes the bundle and gives its index rows."""
        self._close_frame()
        out = self.index
        if self.frames:
            write_bytes(self.name, b"".join(self.frames) + seek_table(self.table))
        self._new()
        return out


def _words(digests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second 64 bits of hexadecimal digests."""
    raw = np.frombuffer(b"".join(bytes.fromhex(x[:32]) for x in digests), ">u8").reshape(-1, 2).astype(np.uint64)
    return raw[:, 0], raw[:, 1]


def _repeated(rows: DataFrame, folder: str, least: int) -> HashStore:
    """Stores of each payload of `least` bytes or more that several rows have the smallest page id and the number of rows.  Only digests and ids travel."""
    groups = rows.where(F.length("payload") >= least).groupBy(F.sha2("payload", 256).alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    groups.write.parquet(f"{folder}/groups")
    groups = rows.sparkSession.read.schema("digest string, first long, n long").parquet(f"{folder}/groups")
    store = HashStore(folder, "repeated", shard_bits(groups.count(), 100_000), ("other", "first", "n"))
    top = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")

    def gather(key, table):
        d1, d2 = _words(table.column("digest").to_pylist())
        order = np.lexsort((d2, d1))
        first, n = (table.column(c).to_numpy() for c in ("first", "n"))
        store.write(key[0].as_py(), key=d1[order], other=d2[order], first=first[order], n=n[order])
        return pa.table({"n": [table.num_rows]})

    groups.withColumn("shard", F.shiftright(top, 32 - store.bits)).groupBy("shard").applyInArrow(gather, "n long").agg(F.sum("n")).collect()
    return store


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Writes a record for each row into bundles in the shared folder and returns their index (read back from there).

    Null payload: empty; null url: no target.  Of equal payloads of `least` bytes or more the smallest id's rows are responses (all of them, if that id's row is
    repeated) and the others revisits of one of these; a null id is never the smallest, and rows of equal payload with null ids only are all responses.  Each row has a
    record with an id of its own, repeated rows too.  A payload of any length is one record, which may be larger than a frame.  An empty table gives an empty index.
    A task that is repeated writes new bundles; the index names only those of the attempt that counted.
    """
    spark = pages.sparkSession
    folder = workspace(spark, "warc", kept=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    repeated = _repeated(rows, folder, least)
    names = ["page_id", "record_id", "bundle", "frame", "at", "length", "url", "digest", "size", "first", "parts"]
    types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())

    def respond(batches):
        """Index rows of responses; those that others revisit with url, digest, id and parts, and all that a revisit needs without a place."""
        out = Bundles(folder, level)
        named: dict[str, tuple] = {}
        for batch in batches:
            digests = batch.column(3).to_pylist()
            d1, d2 = _words(digests)
            order = np.lexsort((d2, d1))
            found, got = repeated.lookup(d1[order], None, d2[order])
            known, first, n = np.zeros(len(d1), bool), np.zeros(len(d1), np.int64), np.zeros(len(d1), np.int64)
            known[order], first[order], n[order] = found, got["first"], got["n"]
            later = []
            for i in range(batch.num_rows):
                page, url, payload = (batch.column(c)[i].as_py() for c in range(3))
                group = (url, digests[i], len(payload), int(first[i]), int(-(-n[i] // PART))) if known[i] and len(payload) >= least else None
                if group is not None and page != group[3]:
                    later.append((page, None, None, None, None, None, *group))
                    continue
                rid, data = record(page, url, payload, len(payload), digests[i], date)
                out.add(page, rid, data)
                if group is not None:
                    named[rid] = group
                if out.full:
                    later += [(*x, *named.get(x[1], (None,) * 5)) for x in out.close()]
                    named = {}
            if later:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*later), types)], names=names)
        last = [(*x, *named.get(x[1], (None,) * 5)) for x in out.close()]
        if last:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*last), types)], names=names)

    schema = f"{_INDEX}, url string, digest string, size long, first long, parts int"
    rows.withColumn("digest", F.sha2("payload", 256)).mapInArrow(respond, schema).write.parquet(f"{folder}/responses")
    done = spark.read.schema(schema).parquet(f"{folder}/responses")
    targets = done.where("record_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("record_id", "url")).alias("r"), F.max("parts").alias("parts"))
    # A group's response is dealt out as often as its revisits fill parts, so that none of them meet in one task in great numbers.
    targets = targets.select("digest", "r", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    later = done.where("record_id IS NULL").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.col("parts")).cast("int"))
    later = later.join(targets, ["digest", "part"]).select("page_id", later["url"], "digest", "size", "first", "r.record_id", F.col("r.url").alias("target"))

    def revisit(batches):
        out = Bundles(folder, level)
        for batch in batches:
            for page, url, digest, size, first, rid, target in zip(*(c.to_pylist() for c in batch.columns)):
                out.add(page, *record(page, url, b"", size, digest, date, (first, rid, target)))
                if out.full:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out.close()), types)], names=names[:6])
        if last := out.close():
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*last), types)], names=names[:6])

    later.mapInArrow(revisit, _INDEX).write.parquet(f"{folder}/revisits")
    index = [f.name for f in done.schema.fields[:6]]
    return done.where("record_id IS NOT NULL").select(*index).unionByName(spark.read.schema(_INDEX).parquet(f"{folder}/revisits"))


def read(index: DataFrame) -> DataFrame:
    """(page_id, record_id, url, record_type, refers_to, payload_bytes, payload_digest, payload), one row per row of an index.

    The digest of a response is computed from the payload read back, and must be that of its header; a revisit's are those of its record,
    and its payload is null.
    """

    def fetch(batches):
        bundle: Bundle | None = None
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "at", "length"))))
            for lo in range(0, len(places), 512):
                out = []
                for uri, frame, at, length in places[lo : lo + 512]:
                    if bundle is None or bundle.uri != uri:
                        bundle = Bundle(uri)
                    headers, http, payload = parse(bundle.frame(frame)[at : at + length])
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
                    size, kind = int(fields["content-length"]), headers["warc-type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{uri}, frame {frame}: a payload differs from its digest")
                    page, first = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                    out.append((page and int(page), headers["warc-record-id"].strip("<>"), headers.get("warc-target-uri"), kind, first and int(first), size, digest, payload if kind == "response" else None))
                types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["page_id", "record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    return index.mapInArrow(fetch, "page_id long, record_id string, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
