import gzip
import hashlib
import io
import json
import re
import zipfile

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from lodestar.llm import archives as A
from lodestar.llm.shared import shared_folder


def pages():
    long_ = "<p>" + "x" * 200
    return [
        (5, "http://a/é", long_),
        (3, "http://b/", long_),
        (9, None, long_),
        (4, "http://c/", "short"),
        (6, "http://d/", "short"),
        (7, "http://e/\r\nX: y", None),
        (8, "u", ""),
        (10, "u", "é" * 50),
        (11, "u", "é" * 50),
        (None, "u", long_),
        (3, "http://b/", long_),
    ]


def expected(rows):
    first = {}
    for p, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 100 and p is not None:
            first[data] = min(p, first.get(data, p))
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        refers = first.get(data) if p is not None and first.get(data) != p else None
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "extra") for r in pages()], "page_id long, url string, html string, digest string")
    got = A.archive_round_trip(spark, df)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == expected(pages())
    assert {r.url for r in got.where("page_id = 5").collect()} == {"http://a/%C3%A9"}


def test_empty_table(spark):
    assert A.archive_round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_are_plain_zip_files(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    manifest = A.write_archives(df, shared_folder(spark), archive_bytes=500)
    paths = [r.path for r in manifest.collect()]
    assert len(paths) > 2
    kinds = []
    for path in paths:
        store, name = A.file_system(path)
        with zipfile.ZipFile(io.BytesIO(store.open_input_file(name).readall())) as z:
            assert z.testzip() is None and z.namelist() == [A.DATA, A.INDEX]
            kinds += [x for x in gzip.decompress(z.read(A.DATA)).split(b"\r\n") if x.startswith(b"WARC-Type")]
    assert len(kinds) == len(pages())
    assert sorted((tuple(r)[:5] for r in A.read_archives(manifest).collect()), key=str) == expected(pages())


@pytest.mark.parametrize("limit", [A.LIMIT32, 3])
def test_directories(tmp_path, limit):
    with open(tmp_path / "a.zip", "wb") as out:
        z = A.ZipWriter(out, limit)
        for name in ("one", "two"):
            z.begin(name)
            z.write(name.encode() * 5)
            z.end()
        z.close()
    assert zipfile.ZipFile(tmp_path / "a.zip").read("two") == b"two" * 5
    file = fs.LocalFileSystem().open_input_file(str(tmp_path / "a.zip"))
    members = A.directory(file, file.size())
    at, size = A.member_data(file, members, "two")
    assert file.read_at(size, at) == b"two" * 5


@pytest.mark.parametrize("force", [False, True])
@pytest.mark.parametrize("packed", [False, True])
def test_foreign_archives(spark, tmp_path, force, packed):
    records = [A.record(k, "http://x", b"y" * k, hashlib.sha256(b"y" * k).hexdigest(), None, "2020-01-01T00:00:00Z") for k in range(4)]
    name = "w.warc.gz" if packed else "w.warc"
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.comment = b"PK\5\6 a comment"
        with z.open(name, "w", force_zip64=force) as m:
            for r in records:
                m.write(gzip.compress(r) if packed else r)
    got = A.read_archives(spark.createDataFrame([(f"file://{tmp_path}/f.zip",)], "path string")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(k, k) for k in range(4)]


@pytest.mark.parametrize("end", ["", "\n"])
def test_foreign_archives_of_several_members(spark, tmp_path, end):
    """Two members by the index, whose lines name them either way, and two that it does not cover."""
    records = [gzip.compress(A.record(k, "http://x", b"y" * k, hashlib.sha256(b"y" * k).hexdigest(), None, "2020-01-01T00:00:00Z")) for k in range(12)]
    members = {"archive/a.warc.gz": records[:3], "archive/b.warc.gz": records[3:6], "archive/c.warc.gz": records[6:9], "d.warc": [gzip.decompress(r) for r in records[9:]]}
    lines = []
    for name, shown in (("archive/b.warc.gz", "b.warc.gz"), ("archive/a.warc.gz", "archive/a.warc.gz")):
        at = 0
        for r in members[name]:
            lines.append(f'x 2020 {{"offset": "{at}", "length": "{len(r)}", "filename": "{shown}"}}')
            at += len(r)
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        for name, parts in members.items():
            z.writestr(name, b"".join(parts))
        z.writestr(A.INDEX, "\n".join(lines) + end)
    got = A.read_archives(spark.createDataFrame([(f"file://{tmp_path}/f.zip",)], "path string")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(k, k) for k in range(12)]


@pytest.mark.parametrize("name", ["indexes/index.cdx.gz", "indexes/index.cdx", "indexes/part.cdxj.gz"])
def test_other_indexes(spark, tmp_path, name):
    """Columns or JSON, plain or as several gzip members; what the index leaves out is no record."""
    records = [gzip.compress(A.record(k, "http://x", b"y" * k, hashlib.sha256(b"y" * k).hexdigest(), None, "2020-01-01T00:00:00Z")) for k in range(6)]
    at = [sum(map(len, records[:k])) for k in range(6)]
    lines = [f"x)/ 2020 http://x text/html 200 D - - {len(r)} {a} w.warc.gz\n" if ".cdx." in name + "." else f'x)/ 2020 {{"filename": "w.warc.gz", "offset": {a}, "length": {len(r)}}}\n' for r, a in list(zip(records, at, strict=True))[1:]]
    head = [" CDX N b a m s k r M S V g\n"] if ".cdx." in name + "." else []
    packed = b"".join(gzip.compress(x.encode()) for x in head + lines) if name.endswith(".gz") else "".join(head + lines).encode()
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("archive/w.warc.gz", b"".join(records))
        z.writestr(name, packed)
    got = A.read_archives(spark.createDataFrame([(f"file://{tmp_path}/f.zip", 1)], "path string, bytes long")).collect()
    assert sorted(r.page_id for r in got) == list(range(1, 6))


def test_written_index(spark):
    rows = [(1, "http://b.a.com/P?q=1", "x" * 200), (2, None, "y"), (3, "http://[", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    store, name = A.file_system(A.write_archives(df, shared_folder(spark)).first().path)
    with zipfile.ZipFile(io.BytesIO(store.open_input_file(name).readall())) as z:
        lines = z.read(A.INDEX).decode().splitlines()
    assert [x.split(" ")[0] for x in lines] == ["-", "-", "com,a,b)/p?q=1"]
    assert all(re.fullmatch(r"[0-9]{14}", x.split(" ")[1]) for x in lines)
    assert json.loads(lines[2].split(" ", 2)[2])["filename"] == "data.warc.gz"


def test_large_archives_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(A, "SLICE_BYTES", 4096)
    df = spark.range(300).select(F.col("id").alias("page_id"), F.lit("http://x/").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html")).coalesce(1)
    found = A.read_archives(A.write_archives(df, shared_folder(spark)))
    tasks = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 4 and sum(r["count"] for r in tasks) == 300


def test_unclear_index_lines_are_errors():
    data = {"x/a.warc": (0, 1), "y/a.warc": (1, 1)}
    assert A._named_member("y/a.warc", data) == "y/a.warc"
    for named in ("a.warc", "b.warc", None):
        with pytest.raises(ValueError, match="index line"):
            A._named_member(named, data)


def test_faults(tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 1000)
    file = fs.LocalFileSystem().open_input_file(str(tmp_path / "c.zip"))
    with pytest.raises(ValueError, match="compressed"):
        A.member_data(file, A.directory(file, file.size()), "a")
    (tmp_path / "n.zip").write_bytes(b"nothing here")
    file = fs.LocalFileSystem().open_input_file(str(tmp_path / "n.zip"))
    with pytest.raises(ValueError, match="not a ZIP"):
        A.directory(file, file.size())
    bad = A.record(1, "u", b"payload", "0" * 64, None, "2020-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        A.parse_record(bad)
