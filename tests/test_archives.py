"""Package archives against Python's own writer."""

import io
import tarfile

from pyspark.sql import functions as F

from tessera.sources import archives


def tgz(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.SYMTYPE
                info.linkname = "elsewhere"
                t.addfile(info)
            else:
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_files_of_archives(spark, tmp_path):
    long = "package/" + "deep/" * 40 + "x.js"
    good = {"package/index.js": b"a();\n", "package/lib/b.js": b"\xff\x00" * 700, "./package/empty.js": b"", "other/c.js": b"c", "package/link": None, long: b"long"}
    (tmp_path / "a-1.2.3.tgz").write_bytes(tgz(good))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b-c-2.0.0-rc.1.tgz").write_bytes(tgz({f"package/{k}.js": b"x" * 40_000 for k in range(30)}))
    (tmp_path / "noversion.tgz").write_bytes(tgz({"package/a.js": b"a"}))
    (tmp_path / "cut-1.0.0.tgz").write_bytes(tgz({f"package/{k}.js": bytes(range(256)) * 400 for k in range(3)})[:-300])
    (tmp_path / "bad-1.0.0.tgz").write_bytes(b"\x1f\x8bnothing")
    (tmp_path / "out-1.0.0.tgz").write_bytes(tgz({"package/ok.js": b"1", "../../etc/passwd": b"2"}))
    (tmp_path / "skipped.txt").write_bytes(b"x")
    files = archives.archive_files(spark, str(tmp_path))
    got = {}
    for r in archives.package_files(files).collect():
        got.setdefault((r.name, r.version), {})[r.path] = bytes(r.content)
    assert got["a", "1.2.3"] == {"index.js": b"a();\n", "lib/b.js": b"\xff\x00" * 700, "empty.js": b"", "other/c.js": b"c", "deep/" * 40 + "x.js": b"long"}
    assert len(got["b-c", "2.0.0-rc.1"]) == 30 and got["out", "1.0.0"] == {"ok.js": b"1"}
    assert {("a", "1.2.3"), ("b-c", "2.0.0-rc.1"), ("out", "1.0.0")} <= set(got) <= {("a", "1.2.3"), ("b-c", "2.0.0-rc.1"), ("out", "1.0.0"), ("cut", "1.0.0")}
    errors = {r.archive.rsplit("/", 1)[1]: r.error for r in files.filter("path is null").collect()}
    assert set(errors) == {"cut-1.0.0.tgz", "bad-1.0.0.tgz", "out-1.0.0.tgz"} and "leaves the archive" in errors["out-1.0.0.tgz"]


def test_blocks_are_read_by_others(spark):
    rows = [("package/a.js", "é" * 300), ("package/b.js", ""), ("package/c.js", "x" * 1024)]
    found = spark.createDataFrame(rows, "path string, text string").select(archives.tar_block(F.col("path"), F.col("text")).cast("binary").alias("b")).collect()
    data = b"".join(bytes(r.b) for r in found) + b"\0" * 1024
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        assert [(m.name, t.extractfile(m).read().decode()) for m in t] == rows
