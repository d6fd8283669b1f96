"""Files of gzipped package archives, streamed from the archive in the task that reads it."""

from __future__ import annotations

import io
import tarfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tarball_parts

#: Fixed value: the folder in which an archive keeps its package.
PACKAGE = "package"
FILES = "archive string, path string, content binary, error string"
#: Bytes of files that leave a task at once.
BATCH_BYTES = 8 << 20


def _members(content: bytes):
    """(path, content) of the plain files of an archive, one at a time; links and folders are no files."""
    with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as found:
        for member in found:
            if member.isfile():
                yield member.name, found.extractfile(member).read()


def archive_files(spark: SparkSession, root: str, pattern: str = "*.tgz") -> DataFrame:
    """(archive, path, content, error) of the files in the archives under root: archive is the archive's own path.

    Paths lose leading dots and slashes and the package folder. An archive that can't be read to its end gives the files
    before that and a row with the error and no path; a path that steps out of its archive is such an error. Archives are
    dealt over the tasks by Spark; a task holds one compressed archive and one file of it.
    """

    def run(batches):
        names = [f.split()[0] for f in FILES.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if n == "content" else pa.string()) for k, n in enumerate(names)], names)

        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out, size = [], 0
                try:
                    for name, data in _members(content.as_py()):
                        steps = [s for s in name.split("/") if s not in ("", ".")]
                        if ".." in steps or "\\" in name:
                            raise tarfile.TarError(f"a path leaves the archive: {name}")
                        out.append((archive, "/".join(steps[1:] if steps[:1] == [PACKAGE] and len(steps) > 1 else steps), data, None))
                        size += len(data)
                        if size > BATCH_BYTES:
                            yield batch(out)
                            out, size = [], 0
                except (tarfile.TarError, EOFError, OSError, zlib.error) as e:
                    out.append((archive, None, None, str(e)))
                yield batch(out)

    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return found.select("path", "content").mapInArrow(run, FILES)


def package_files(files: DataFrame, file: Column | None = None) -> DataFrame:
    """(name, version, path, content) of the files of archives whose file name says a name and a version; damaged ones are left out."""
    file = F.element_at(F.split("archive", "/"), -1) if file is None else file
    named = files.filter("path is not null").withColumn("_parts", tarball_parts(file)).filter("_parts is not null")
    return named.select("_parts.name", "_parts.version", "path", "content")


def tar_block(path: Column, content: Column) -> Column:
    """The bytes of one file in an archive (USTAR): a header of 512 bytes and the content, filled up to blocks. Paths have 99 bytes at most."""
    nul = lambda n: F.repeat(F.lit("\0"), n)
    size, octal = F.octet_length(content), lambda n, width: F.lpad(F.conv(n.cast("string"), 10, 8), width, "0")
    head = [F.rpad(path, 100, "\0"), F.lit("0000644\0"), F.lit("0000000\0" * 2), octal(size, 11), F.lit("\0" + "0" * 11 + "\0")]
    rest = [F.lit("0"), nul(F.lit(100)), F.lit("ustar\0" + "00"), nul(F.lit(247))]
    blank = F.concat(*head, F.lit(" " * 8), *rest)
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(512)), lambda i: F.ascii(F.substr(blank, i, F.lit(1)))), F.lit(0), lambda a, x: a + x)
    return F.concat(*head, octal(total, 6), F.lit("\0 "), *rest, content, nul(F.pmod(-size, F.lit(512)).cast("int")))
