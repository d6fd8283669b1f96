"""Scalar functions on names, comments, source text, paths and archive names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what joins the names of nested functions.
NAME_SEPARATOR = ":>>:"
ANONYMOUS = "[anonymous]"

#: The mention patterns, and the limits from which source text counts as minified.
MENTION = r"([\w-]+)\s+(?:@?version\s+)?(v?\d+\.\d+\.\d+)"
MENTION_FIRST = r"(\w+)\s(\d+\.\d+\.\d+)"
TARBALL = r"^(.*)-(\d+\.\d+\.\d+.*)\.tgz$"
APK = r"^(.*)-(\d+)-(\d{4}_\d{2}_\d{2})\.apk$"
LONG_LINE, LONG_RATIO, SHORT_NAME, MANY_SHORT = 130, 0.9, 4, 0.9


def join_names(outer: Column, inner: Column) -> Column:
    return F.when(outer == "", inner).otherwise(F.concat_ws(NAME_SEPARATOR, outer, inner))


def split_names(name: Column) -> Column:
    return F.split(name, NAME_SEPARATOR)


def is_anonymous(name: Column) -> Column:
    return F.element_at(split_names(name), -1) == ANONYMOUS


def left_pad(s: Column, width: int = 4) -> Column:
    """Zero-padded; a longer text stays whole."""
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def average_line_length(src: Column) -> Column:
    lines = F.split(src, "\n")
    return F.floor(F.aggregate(lines, F.lit(0).cast("long"), lambda n, line: n + F.length(line)) / F.size(lines))


def long_lines_ratio(src: Column) -> Column:
    """The accumulator is divided by the text's length at every line; an empty text gives null."""
    lines, n = F.split(src, "\n"), F.length(src)
    size = lambda line: F.length(line).cast("double")  # noqa: E731  the square of an int ends at 46,340 characters
    fold = F.aggregate(lines, F.lit(0.0), lambda acc, line: (acc + size(line) * size(line)) / F.when(n > 0, n))
    return fold / F.size(lines)


def is_minified(src: Column) -> Column:
    return (average_line_length(src) > LONG_LINE) | F.coalesce(long_lines_ratio(src) > LONG_RATIO, F.lit(False))


def short_name_ratio(names: Column) -> Column:
    """Share of functions whose last name is anonymous or shorter than four; no functions give null."""
    last = F.transform(names, lambda n: F.element_at(split_names(n), -1))
    short = F.size(F.filter(last, lambda n: (n == ANONYMOUS) | (F.length(n) < SHORT_NAME)))
    return short / F.when(F.size(names) > 0, F.size(names))


def is_signature_minified(names: Column) -> Column:
    """Whether most functions have short names or none; no functions aren't minified."""
    return F.coalesce(short_name_ratio(names) > MANY_SHORT, F.lit(False))


def mentions(text: Column) -> Column:
    """All (name, version) mentions of a comment."""
    name, version = F.regexp_extract_all(text, F.lit(MENTION), 1), F.regexp_extract_all(text, F.lit(MENTION), 2)
    return F.zip_with(name, version, lambda n, v: F.struct(n.alias("name"), v.alias("version")))


def first_mention(text: Column) -> Column:
    found = F.regexp_extract(text, MENTION_FIRST, 0) != ""
    return F.when(found, F.struct(F.regexp_extract(text, MENTION_FIRST, 1).alias("name"), F.regexp_extract(text, MENTION_FIRST, 2).alias("version")))


def escaped(name: Column) -> Column:
    return F.regexp_replace(name, r"([.*+?^${}()|\[\]\\/-])", r"\\$1")


def name_count(text: Column, name: Column) -> Column:
    """Times the name stands between two characters that aren't word characters; neighbours can't share one."""
    return F.regexp_count(text, F.concat(F.lit(r"[\W_]"), escaped(name), F.lit(r"[\W_]")))


def tarball_parts(file: Column) -> Column:
    """{name, version} of an archive's file name (the name takes as much as it can), or null."""
    return F.when(file.rlike(TARBALL), F.struct(F.regexp_extract(file, TARBALL, 1).alias("name"), F.regexp_extract(file, TARBALL, 2).alias("version")))


def apk_parts(file: Column) -> Column:
    found = F.struct(F.regexp_extract(file, APK, 1).alias("name"), F.regexp_extract(file, APK, 2).cast("long").alias("build"), F.to_date(F.regexp_extract(file, APK, 3), "yyyy_MM_dd").alias("date"))
    return F.when(file.rlike(APK), found)


def source_kind(src: Column) -> Column:
    """file, http(s) or unknown, by the protocol of a script's src relative to a file page."""
    scheme = F.lower(F.regexp_extract(src, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(src.isNull(), None).when(src.startswith("//") | (scheme == "") | (scheme == "file"), "file").when(scheme.isin("http", "https"), "http").otherwise("unknown")


def csv_cell(cell: Column) -> Column:
    """Only the first comma of a cell becomes an underscore."""
    return F.regexp_replace(cell, "^([^,]*),", "$1_")


def csv_line(*cells: Column) -> Column:
    return F.concat_ws(",", *[csv_cell(c) for c in cells])


def fraction_tex(num: Column, den: Column) -> Column:
    return F.format_string("\\dfrac{%d}{%d} (%.1f\\%%)", num, den, 100.0 * num / F.when(den != 0, den))


def script_name(path: Column) -> Column:
    """Name of a runnable script under src/bin or bin, else null: no hidden parts, typings, maps, index, workers or tests."""
    clean = F.regexp_replace(F.regexp_replace(path, r"^(\./)+", ""), r"/+", "/")
    rest = F.regexp_extract(clean, r"^(?:dist/|src/)?bin/(.+)$", 1)
    bad = rest.rlike(r"(^|/)_|\.d\.ts$|\.js\.map$|\.worker\.[jt]s$|\.test\.[jt]s$|(^|/)index(\.[jt]s)?$")
    kebab = F.lower(F.regexp_replace(F.regexp_replace(rest, r"\.[jt]s$", ""), r"([a-z0-9])([A-Z])", "$1-$2"))
    return F.when((rest != "") & ~bad, kebab)
