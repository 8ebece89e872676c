"""A deterministic sharded WARC writer, and a reader of what it wrote.

Pages are cut into shards by ranges of page id whose bounds come from exact sums of payload bytes, never from samples, so
a rerun makes the same files byte for byte; pages of one id, or of none, that outweigh a shard are dealt to several by
their digest. One shuffle brings a shard's pages together; the shard is sorted, every
record gets headers and digests anew, and gzip members go to files that roll at ``roll_bytes`` compressed. A file is
written under a temporary name and renamed when whole; a rerun of a lost task renames equal bytes over it. The manifest,
committed last in the same way, names the files that count: readers open those and no others.

Equal payloads of at least ``LEAST_REVISIT`` bytes are stored once, with the smallest page id; the others become revisit
records that refer to it. Which payloads repeat is found by an aggregate over digests, and a shard is sent only its own
repeated digests, so a payload of very many copies is no burden to one task.

Defined results: null HTML is an empty payload; a null page id sorts first, gives a record without an id and is only a
revisit where some copy has an id; rows that repeat a page id and payload are a response and revisits of it; an empty
table gives a manifest without files and no rows. Paths are URIs of any file system that Arrow can write.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

LEAST_REVISIT = 100
SHARD_BYTES = 24 << 20  # of payload in a shard; what a task holds at once
ROLL_BYTES = 8 << 20  # of a compressed file; the manifest, a row for each, passes through the driver, so raise both with the input
MOST_TASKS = 100_000
DATE = "2024-01-01T00:00:00Z"
CELLS = 1 << 16  # sums that one pass of the search for bounds may bring to the driver, and two for each heavy cell
PIECE = 4096  # bytes that the reader first feeds to a record
_SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs
_FILES = "shard long, seq long, name string, bytes long, records long, sha256 string"


def _bounds(keys: DataFrame, shard_bytes: int) -> tuple[list[int], list[int]]:
    """The first page id of each shard but the first, and how many parts each shard has.

    Cells of equal width are summed, all heavy ones of a width are split again by one aggregate. A page id that alone
    outweighs a shard is one of several parts. The lists grow by one number for ``shard_bytes`` of pages.
    """
    low, high = keys.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return [], []
    width = 1
    while (high - low) // width >= CELLS:
        width *= 2
    begin = lambda w: F.coalesce(F.try_subtract(F.col("id"), F.pmod("id", F.lit(w))), F.lit(-(2**63)))
    sums, here = {}, keys
    while True:
        found = dict(here.groupBy(begin(width).alias("at")).agg(F.sum("size")).collect())
        heavy = [at for at, n in found.items() if n > shard_bytes and width > 1]
        sums |= {at: n for at, n in found.items() if n <= shard_bytes or width == 1}
        if not heavy:
            break
        known = keys.sparkSession.createDataFrame([(at,) for at in heavy], "heavy long")
        here = keys.join(F.broadcast(known), begin(width) == F.col("heavy"), "left_semi")  # fewer than shards
        fan = 2
        while fan * len(heavy) <= CELLS // 2:
            fan *= 2
        width = max(1, width // fan)
    starts, parts, held = [], [1], 0
    for at in sorted(sums):
        if held and held + sums[at] > shard_bytes:
            starts.append(at)
            parts.append(1)
            held = 0
        held += sums[at]
        parts[-1] = max(1, -(-held // shard_bytes))
    return starts, parts


def _with_shard(bounds: list[int], parts: list[int], no_id: int):
    """Adds a shard to batches with the columns id and digest: pages without an id come first, in ``no_id`` shards."""
    cuts, many = np.array(bounds, np.int64), np.array(parts or [1], np.int64)
    first = no_id + np.cumsum(many) - many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            at = np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
            shard, of = first[at], many[at]
            none = ids.is_null().to_numpy(zero_copy_only=False)
            shard[none], of[none] = 0, no_id
            split = np.flatnonzero(of > 1)
            if len(split):
                digests = batch.column(batch.schema.get_field_index("digest")).take(pa.array(split)).to_pylist()
                shard[split] += np.array([int(d[:12], 16) for d in digests], np.int64) % of[split]
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], ["shard", *batch.schema.names])

    return run


def _record_id(page_id: int | None, digest: str, turn: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, f'{page_id}/{digest}/{turn}')}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return gzip.compress(head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _line(value: object) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in str(value))


def _page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, turn: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest, turn)), ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(url or "")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", "" if page_id is None else page_id), ("X-Payload-Length", len(payload)),
    ]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(first, digest)), ("X-Refers-To-Page", first)]
    return _record(headers, block)


class _Roll:
    """Files of one shard, each under a temporary name until whole."""

    def __init__(self, folder: str, shard: int, roll_bytes: int) -> None:
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.shard, self.roll_bytes, self.done, self.out = shard, roll_bytes, [], None

    def add(self, member: bytes) -> None:
        if self.out is not None and self.size + len(member) > self.roll_bytes:
            self.close()
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{len(self.done):05d}.warc.gz"
            self.temporary = f"{self.path}/_tmp-{uuid.uuid4().hex}-{self.name}"
            self.out, self.size, self.records, self.sum = self.store.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            info = f"software: shotline\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._put(member)
        self.records += 1

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sum.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temporary, f"{self.path}/{self.name}")
            self.done.append((self.shard, len(self.done), self.name, self.size, self.records, self.sum.hexdigest()))
            self.out = None


def _write_shard(folder: str, roll_bytes: int):
    def run(key: tuple, pages: pa.Table, repeated: pa.Table) -> pa.Table:
        first = dict(zip(repeated["digest"].to_pylist(), repeated["first"].to_pylist(), strict=True))
        roll, stored_here, turns = _Roll(folder, key[0].as_py() if pages.num_rows else 0, roll_bytes), set(), {}
        pages = pages.sort_by([("id", "ascending"), ("url", "ascending"), ("digest", "ascending")])
        for batch in pages.to_batches(max_chunksize=256):
            for page_id, url, digest, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "url", "digest", "html")), strict=True):
                payload = (text or "").encode("utf-8", "surrogatepass")
                own = first.get(digest)
                revisit = own is not None and (page_id != own or digest in stored_here)
                if own is not None and page_id == own:
                    stored_here.add(digest)
                turn = turns[page_id, digest] = turns.get((page_id, digest), -1) + 1
                roll.add(_page_record(page_id, url, payload, digest, own, revisit, turn))
        roll.close()
        columns = list(zip(*roll.done, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _FILES.split(", ")])

    return run


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[dict]:
    """Write the pages to ``folder`` and return the manifest, also committed there as ``manifest.json``."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.sha2(html.cast("binary"), 256).alias("digest"), html.alias("html"))
    keys = stored(rows.select("id", "digest", (F.octet_length("html") + 1).cast("long").alias("size")), "payloads")
    without = keys.agg(F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("size"))), F.lit(0))).first()[0]
    no_id = -(-without // shard_bytes)
    bounds, parts = _bounds(keys.filter("id IS NOT NULL"), shard_bytes)
    cut = _with_shard(bounds, parts, no_id)
    tasks = max(1, min(4 * (no_id + sum(parts)), MOST_TASKS))  # shards meet by hash, so more tasks than shards
    repeated = keys.filter(F.col("size") > LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    where = keys.select("id", "digest").mapInArrow(cut, "shard long, id long, digest string").select("shard", "digest").distinct()
    repeated = where.join(repeated, "digest").select("shard", "digest", "first")
    placed = rows.mapInArrow(cut, "shard long, id long, url string, digest string, html string")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    files = placed.repartition(tasks, "shard").groupBy("shard").cogroup(repeated.repartition(tasks, "shard").groupBy("shard")).applyInArrow(_write_shard(folder, roll_bytes), _FILES)
    manifest = sorted((r.asDict() for r in files.collect()), key=lambda r: (r["shard"], r["seq"]))  # a row for each file
    temporary = f"{path}/_tmp-{uuid.uuid4().hex}-manifest.json"
    with store.open_output_stream(temporary) as out:
        out.write(json.dumps({"files": manifest}, indent=1).encode())
    store.move(temporary, f"{path}/manifest.json")
    for left in store.get_file_info(fs.FileSelector(path)):  # by tasks that failed or were done twice
        if left.base_name.startswith("_tmp-"):
            store.delete_file(left.path)
    return manifest


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file of gzip members."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, pieces, step = zlib.decompressobj(31), [], PIECE
        while not member.eof:
            if at >= len(view):
                raise ValueError("the last record is cut off")
            piece = view[at : at + step]
            pieces.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
            step *= 2
        whole = b"".join(pieces)
        head, _, rest = whole.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    for batch in batches:
        for data in batch.column(0):
            rows, held = [], 0
            for headers, block in records(data.as_py()):
                if headers["WARC-Type"] == "warcinfo":
                    continue
                digest, revisit = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"] == "revisit"
                payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                if f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["WARC-Block-Digest"] or (payload is not None and hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"digest mismatch in record {headers['WARC-Record-ID']}")
                page, refers = headers["X-Page-ID"], headers.get("X-Refers-To-Page")
                rows.append((int(page) if page else None, headers["WARC-Target-URI"], payload, int(headers["X-Payload-Length"]) if revisit else len(payload), digest, headers["WARC-Type"], int(refers) if refers else None))
                held += len(block)
                if held > 4 << 20:
                    yield pack(rows)
                    rows, held = [], 0
            if rows:
                yield pack(rows)


RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that the folder's manifest names; digests are checked. A revisit has a null payload."""
    manifest = spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0]
    names = [f["name"] for f in json.loads(manifest)["files"]]
    if not names:
        return spark.createDataFrame([], RECORD)
    return spark.read.format("binaryFile").load([f"{folder}/{n}" for n in names]).select("content").mapInArrow(_parse, RECORD)
