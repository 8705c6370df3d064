"""WARC records in ZIP-packaged archives: write them, find members by the directories, and range-read records.

An archive is a ZIP file with stored (not compressed) members: `archive/data.warc.gz`, one gzip member per record, and
`indexes/index.cdxj`, one line per record: the URL's reversed host and path, the time, and as JSON its file, offset and
length. A reader takes the end of the file, follows the ZIP64 locator where there is one, parses the central directory,
then reads the indexes (`.cdxj` or `.cdx`, plain or gzip) and single records by range; the archive is never extracted.
Archives made elsewhere are read alike; members that are compressed are refused, and an archive without an index, or a
WARC member that no line of the index names, is scanned record by record.

Records of equal payloads of at least `least` bytes: the one of the smallest page_id is a response, the others are
revisits that name it and have no payload. Every other record is a response.

Files are written and read with pyarrow's file systems, by URI, in the folder of shared steps. A task writes to names of
its own and returns them, so files of failed attempts are never read.

Edge cases: a null html is an empty payload; a null url has no target URI; rows without a page_id are responses without
a name; repeated rows of the smallest page_id are all responses. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import materialize, shared_folder

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
INDEXES = (".cdxj", ".cdxj.gz", ".cdx", ".cdx.gz")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 256 << 20
SLICE_BYTES = 8 << 20
LIMIT32 = 0xFFFFFFFF
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# --- ZIP ---------------------------------------------------------------------------------------------------------------


class ZipWriter:
    """Stored members written in one pass; sizes follow each member in a data descriptor.

    Sizes or offsets over `limit` go to ZIP64 fields of the central directory; the ZIP64 end record is always written.
    """

    def __init__(self, out, limit: int = LIMIT32):
        self.out, self.at, self.limit, self.members = out, 0, limit, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, LIMIT32, LIMIT32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> None:
        member = self.members[-1]
        member[2] = zlib.crc32(data, member[2])
        member[3] += len(data)
        self._put(data)

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, size, size))

    def close(self) -> None:
        start = self.at
        for raw, offset, crc, size in self.members:
            big = [x for x in (size, size, offset) if x > self.limit]
            extra = struct.pack(f"<HH{len(big)}Q", 1, 8 * len(big), *big) if big else b""
            low = [LIMIT32 if x > self.limit else x for x in (size, offset)]
            self._put(
                struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, crc, low[0], low[0], len(raw), len(extra), 0, 0, 0, 0, low[1])
                + raw
                + extra
            )
        size, end, n = self.at - start, self.at, len(self.members)
        self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, LIMIT32), min(start, LIMIT32), 0))


def directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, size, offset of the local header) of the members, from the central directory."""
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    at = len(tail) - 22
    while at >= 0 and not (tail[at : at + 4] == b"PK\5\6" and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at + 3) if at else -1
    if at < 0:
        raise ValueError("not a ZIP archive: no end of central directory")
    length, start = struct.unpack_from("<II", tail, at + 12)
    locator = tail_at + at - 20
    if locator >= 0:
        found = file.read_at(20, locator)
        if found[:4] == b"PK\6\7":
            end = file.read_at(56, struct.unpack_from("<Q", found, 8)[0])
            if end[:4] != b"PK\6\6":
                raise ValueError("broken ZIP64 locator")
            length, start = struct.unpack_from("<QQ", end, 40)
    entries, members, at = file.read_at(length, start), {}, 0
    while at < length:
        if entries[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", entries, at + 10)
        sizes = list(struct.unpack_from("<II", entries, at + 20))
        n, extra, comment = struct.unpack_from("<HHH", entries, at + 28)
        offset, = struct.unpack_from("<I", entries, at + 42)
        name = entries[at + 46 : at + 46 + n].decode("utf-8", "replace")
        field, stop = at + 46 + n, at + 46 + n + extra
        while field + 4 <= stop:
            tag, width = struct.unpack_from("<HH", entries, field)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{width // 8}Q", entries, field + 4))
                plain = next(wide) if sizes[1] == LIMIT32 else sizes[1]
                sizes[0] = next(wide) if sizes[0] == LIMIT32 else sizes[0]
                sizes[1] = plain
                offset = next(wide) if offset == LIMIT32 else offset
            field += 4 + width
        members[name] = (method, sizes[1], offset)
        at += 46 + n + extra + comment
    return members


def member_data(file, members: dict, name: str) -> tuple[int, int]:
    """Offset and size of a stored member's bytes in the archive."""
    method, size, header = members[name]
    if method:
        raise ValueError(f"{name} is compressed; only stored members can be read by range")
    n, extra = struct.unpack_from("<HH", file.read_at(30, header), 26)
    return header + 30 + n + extra, size


# --- WARC --------------------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~')}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers is not None:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <urn:page:{refers}>"]
    block = http if refers is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def sort_key(url: str | None) -> str:
    """The host's names from the last to the first, then the rest of the URL in lower case; - without a URL."""
    try:
        parts = urlsplit(url or "")
    except ValueError:
        return "-"
    if not parts.hostname:
        return "-"
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(f"{','.join(reversed(parts.hostname.split('.')))}){rest.lower()}", safe="!#$%&()*+,/:;=?@[]~")


def parse_record(data: bytes) -> tuple:
    """A row of READ from a record; the digest of a payload that is there must be right."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    length = next(int(v) for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")) if k.lower() == "content-length")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    number = lambda x: int(x[10:-1]) if x and x.startswith("<urn:page:") else None
    return number(fields["warc-record-id"]), length, digest, fields["warc-type"], number(fields.get("warc-refers-to")), fields.get("warc-target-uri")


def _write(folder: str, date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        out = archive = None
        index: list[bytes] = []

        def finish() -> pa.RecordBatch:
            archive.end()
            archive.begin(INDEX)
            for line in sorted(index):
                archive.write(line)
            archive.end()
            archive.close()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [archive.at], "records": [len(index)]})

        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(batch.column(k) for k in range(5)), strict=True):
                if archive is None:
                    name = f"pages-{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(f"{root}/{name}")
                    archive, index = ZipWriter(out), []
                    archive.begin(DATA)
                page = page_id.as_py()
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                packed = gzip.compress(record(page, url.as_py(), payload, digest.as_py(), refers.as_py(), date), 6, mtime=0)
                where = {"url": url.as_py(), "digest": f"sha256:{digest.as_py()}", "filename": DATA.rsplit("/", 1)[1], "offset": archive.members[0][3], "length": len(packed)}
                index.append(f"{sort_key(url.as_py())} {re.sub('[^0-9]', '', date)} {json.dumps(where)}\n".encode())
                archive.write(packed)
                if archive.at >= archive_bytes:
                    yield finish()
                    archive = None
        if archive is not None:
            yield finish()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) to archives in folder; returns the manifest: path, bytes, records."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2(F.col("html"), 256))
    long_ = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    firsts = long_.groupBy("digest").agg(F.min("page_id").alias("refers"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = long_.join(firsts, "digest").where("page_id <> refers").distinct()
    marked = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    files = marked.mapInArrow(_write(f"{folder}/files", date, archive_bytes), "path string, bytes long, records long")
    return materialize(files, folder, "manifest")


def _index_lines(file, at: int, left: int, packed: bool) -> Iterator[bytes]:
    """The lines of a stored index, gzip or not, the last one with or without a newline."""
    inflate, kept = zlib.decompressobj(wbits=31), b""
    while left:
        part = file.read_at(min(left, SLICE_BYTES), at)
        if not part:
            raise ValueError("archive ends within its index")
        at, left = at + len(part), left - len(part)
        if packed:
            plain = []
            while part:
                plain.append(inflate.decompress(part))
                part = inflate.unused_data
                if inflate.eof and (part or left):
                    inflate = zlib.decompressobj(wbits=31)
            part = b"".join(plain)
        *full, kept = (kept + part).split(b"\n")
        yield from full
    yield kept


def _index_entry(line: bytes) -> tuple[str | None, int, int] | None:
    """(file, offset, length) of a line: JSON after a key and a time, or the last three of eleven columns."""
    at = line.find(b" {") + 1
    if at or line.startswith(b"{"):
        x = json.loads(line[at:])
        return x.get("filename"), int(x["offset"]), int(x["length"])
    columns = line.decode().split()
    if len(columns) == 11 and columns[-2].isdigit():
        return columns[-1], int(columns[-2]), int(columns[-3])
    return None


def _named_member(named: str | None, data: dict) -> str:
    """The WARC member that an index line means: by its name, or the end of it, or the only one if the line has none."""
    if named is None and len(data) == 1:
        return next(iter(data))
    if named in data:
        return named
    ends = [m for m in data if named is not None and m.endswith(f"/{named}")]
    if len(ends) != 1:
        raise ValueError(f"an index line names {named!r}, which is none or several of the members {sorted(data)}")
    return ends[0]


def _places(file, members: dict) -> Iterator[tuple[int, int, bool]]:
    """(offset, length, whether to scan) of the records of all WARC members: by the index, and whole members that no line
    of it names."""
    data = {m: member_data(file, members, m) for m in members if m.endswith((".warc.gz", ".warc"))}
    if not data:
        raise ValueError("an archive without WARC members")
    indexed = set()
    for name in sorted(m for m in members if m.startswith("indexes/") and m.endswith(INDEXES)):
        for line in _index_lines(file, *member_data(file, members, name), name.endswith(".gz")):
            entry = _index_entry(line)
            if entry:
                member = _named_member(entry[0], data)
                indexed.add(member)
                yield data[member][0] + entry[1], entry[2], False
    for member in data.keys() - indexed:
        base, size = data[member]
        if size:
            yield base, size, True


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of archives -> where their records are: path, offset, length, and whether it is a member to scan whole."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, name = file_system(path)
            with store.open_input_file(name) as file:
                places = list(_places(file, directory(file, file.size())))
            offsets, lengths, scans = zip(*places, strict=True) if places else ((), (), ())
            arrays = [pa.array([path] * len(places), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(scans, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["path", "offset", "length", "scan"])


def _scan(file, offset: int, length: int) -> Iterator[bytes]:
    """The gzip members, or plain records, of a stretch of an archive, read piece by piece."""
    end = offset + length
    if file.read_at(min(2, length), offset) != b"\x1f\x8b":
        while offset < end:
            head = b""
            while b"\r\n\r\n" not in head:
                head += file.read_at(min(4096, end - offset - len(head)), offset + len(head))
            head = head[: head.index(b"\r\n\r\n") + 4]
            size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length"))
            yield head + file.read_at(size, offset + len(head))
            offset += len(head) + size + 4
        return
    while offset < end:
        inflate, parts = zlib.decompressobj(wbits=31), []
        while not inflate.eof:
            piece = file.read_at(min(1 << 16, end - offset), offset)
            if not piece:
                raise ValueError("archive ends within a record")
            parts.append(inflate.decompress(piece))
            offset += len(piece) - len(inflate.unused_data)
        yield b"".join(parts)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, file = None, None
    for batch in batches:
        rows = []
        for path, offset, length, scan in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path != name:
                if file:
                    file.close()
                store, where = file_system(path)
                name, file = path, store.open_input_file(where)
            if scan:
                rows += map(parse_record, _scan(file, offset, length))
            else:
                data = file.read_at(length, offset)
                rows.append(parse_record(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, [f.split(" ")[0] for f in READ.split(", ")])


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives whose paths (and bytes, if it has them) the manifest lists: page_id, payload_bytes,
    payload_digest, record_type, refers_to, url. Records are dealt to tasks by slices of SLICE_BYTES of an archive, so a
    large archive is read by many; with the bytes, to as many tasks as there are slices."""
    paths = manifest.select("path")
    slices = -(-(manifest.agg(F.sum("bytes")).first()[0] or 0) // SLICE_BYTES) if "bytes" in manifest.columns else None
    located = paths.repartition("path").mapInArrow(_locate, "path string, offset long, length long, scan boolean")
    dealt = located.withColumn("slice", F.expr(f"offset div {SLICE_BYTES}"))
    dealt = dealt.repartition(max(1, slices), "path", "slice") if slices is not None else dealt.repartition("path", "slice")
    dealt = dealt.sortWithinPartitions("path", "offset").select("path", "offset", "length", "scan")
    return dealt.mapInArrow(_read, READ)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back from there."""
    return read_archives(write_archives(pages, shared_folder(spark)))
