"""Substring dedup by line hashing: units are normalised and hashed, the earliest ranked occurrence stays.

A passage that documents share seldom begins and ends with whole units, so a unit also carries hashes of the words that
stand right before and right after it: equal units with equal words beside them are evidence of a longer shared passage.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import lookup, materialise, table

#: Words beside a unit that are hashed with it.
EDGE_WORDS = 5
#: A run of repeated units is a passage, not a common phrase, if it has so many words, or so many with shared edges.
PASSAGE_WORDS, EDGED_WORDS = 20, 16

_BREAK = re.compile(rb"\n+|(?<=[.!?])[ \t]+")
#: Cuts after sentences that end in closing quotes or other signs too; the group is the white space.
ENDINGS = re.compile(rb"\n+|(?:[.!?]|\xe2\x80\xa6)(?:[!-/:-@\[-`{-~]|\xc2\xbb|\xe2\x80[\x98-\x9f\xa6\xba])*([ \t]+)")


def units_of(text: bytes, least: int = 1, breaks: re.Pattern[bytes] = ENDINGS) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) of the units of a text, as byte offsets: lines, cut after sentences; one of fewer than ``least`` words
    joins the next one of its line.

    Normalised: A-Z lower-cased, white space as single spaces. Blank units are left out.
    """
    out, at, open_at, words = [], 0, None, []

    def close(end):
        nonlocal open_at, words
        if words:
            out.append((open_at, end, words))
        open_at, words = None, []

    for m in [*breaks.finditer(text), None]:
        end = m.start(m.lastindex or 0) if m else len(text)
        if own := text[at:end].lower().split():
            open_at = at if open_at is None else open_at
            words += own
        if not m or text[end] == 10 or len(words) >= least:
            close(end)
        at = m.end() if m else end
    return out


def _edge(words: list[bytes]) -> int | None:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if len(words) == EDGE_WORDS else None


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1, breaks: re.Pattern[bytes] = ENDINGS, row_col: str | None = None) -> DataFrame:
    """(rid, doc_id, idx, start, end, words, digest, before, after) of every unit; rid tells repeated documents apart: the long
    column row_col, or a number. before and after are hashes of the unit's neighbours' nearest words. A document without
    units is one row with only rid and doc_id."""
    names = ["rid", "doc_id", "idx", "start", "end", "words", "digest", "before", "after"]
    kinds = [pa.int64(), None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = []
                part = b.slice(i, 256)
                for rid, doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    own = units_of(text or b"", least, breaks)
                    for k, (start, end, words) in enumerate(own):
                        before = _edge(own[k - 1][2][-EDGE_WORDS:]) if k else None
                        after = _edge(own[k + 1][2][:EDGE_WORDS]) if k + 1 < len(own) else None
                        rows.append((rid, doc, k, start, end, len(words), xxhash.xxh3_128_digest(b" ".join(words)), before, after))
                    if not own:
                        rows.append((rid, doc, *[None] * 7))
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k or part.column(1).type) for c, k in zip(columns, kinds, strict=True)], names)

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select((F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"rid bigint, doc_id {kind}, idx int, start bigint, end bigint, words bigint, digest binary, before bigint, after bigint")


def spans_of(found: DataFrame, run_words: int = 1) -> DataFrame:
    """(rid, doc_id, start, end, n_units, n_words, kept_doc_id, edges, passage) of the repeated spans of a table of ``units``.

    Documents are ranked by id (nulls last, repeated ids by position); of equal units the earliest ranked, then the
    first in the text, stays. Others are spans where consecutive ones hold at least run_words words. kept_doc_id is the
    smallest id that keeps a unit of the span. edges: at how many ends (0 to 2) the words beside the span are those
    beside an equal unit elsewhere. passage: PASSAGE_WORDS words, or EDGED_WORDS with the EDGE_WORDS of each shared edge.
    Digests are grouped globally with a partial aggregation; hot ones are broadcast by a bound on their number, so no
    task gets all copies of a unit.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "idx")
    groups = found.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min(rank).alias("first")).filter("n > 1")
    groups = groups.select("digest", "n", F.col("first.doc_id").alias("kept"), F.col("first.rid").alias("kept_rid"), F.col("first.idx").alias("kept_idx"))
    joined = lookup(found.filter("digest is not null"), groups, "digest", "n", "rid", found.count()).filter("kept_rid is not null")
    ends = F.array(*[F.struct(F.lit(side).alias("side"), F.when(F.col(side).isNotNull(), F.xxhash64("digest", F.lit(side), side)).alias("key")) for side in ("before", "after")])
    names = ["rid", "doc_id", "idx", "start", "end", "words", "kept", (~((F.col("kept_rid") == F.col("rid")) & (F.col("kept_idx") == F.col("idx")))).alias("again")]
    joined = materialise(joined.select(*names, ends.alias("ends")), "repeated")
    sides = joined.select("rid", "idx", "again", F.explode("ends").alias("e")).select("rid", "idx", "again", "e.side", "e.key").filter("key is not null")
    shared = sides.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    marked = lookup(sides.filter("again"), shared, "key", "n", "rid", 2 * joined.count()).filter("n is not null")
    marked = marked.groupBy("rid", "idx").agg(F.bool_or(F.col("side") == "before").alias("left"), F.bool_or(F.col("side") == "after").alias("right"))
    again = joined.filter("again").drop("again", "ends").join(marked, ["rid", "idx"], "left")
    runs = again.withColumn("run", F.col("idx") - F.row_number().over(Window.partitionBy("rid").orderBy("idx")))
    edge = lambda pick, side: F.coalesce(pick(side, "idx"), F.lit(False)).cast("int")
    spans = runs.groupBy("rid", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), F.sum("words").alias("n_words"), F.min("kept").alias("kept_doc_id"), (edge(F.min_by, "left") + edge(F.max_by, "right")).alias("edges"))
    long = (F.col("n_words") >= PASSAGE_WORDS) | ((F.col("edges") > 0) & (F.col("n_words") + EDGE_WORDS * F.col("edges") >= EDGED_WORDS))
    return spans.filter(F.col("n_words") >= run_words).drop("run").withColumn("passage", long)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1, run_words: int = 1, breaks: re.Pattern[bytes] = ENDINGS, row_col: str | None = None) -> DataFrame:
    """``spans_of`` the units of docs, as byte offsets of the original texts: every repeated unit, unless run_words says otherwise.

    Null and blank texts have no units; an empty docs gives no rows; other columns aren't read.
    """
    return spans_of(materialise(units(docs, id_col, text_col, least, breaks, row_col), "units"), run_words)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_hit, n_words, n_repeated, spans) of each row of docs: words in passages that stand in an earlier document
    (or earlier in the text), all words, words in repeated units, and every repeated span as start-end:kept_doc_id:words, with
    an asterisk if it is a passage."""
    found = materialise(units(docs, id_col, text_col), "units")
    whole = found.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.coalesce(F.sum("words"), F.lit(0)).alias("n_words"))
    span = F.concat(F.col("start"), F.lit("-"), F.col("end"), F.lit(":"), F.coalesce(F.col("kept_doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("n_words"), F.when(F.col("passage"), "*").otherwise(""))
    listed = F.array_sort(F.collect_list(F.struct("start", span.alias("span"))))
    per = spans_of(found).groupBy("rid").agg(F.sum(F.when(F.col("passage"), F.col("n_words")).otherwise(0)).alias("n_hit"), F.sum("n_words").alias("n_repeated"), listed.alias("found"))
    out = whole.join(per, "rid", "left").select("doc_id", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "n_words", F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"), F.transform("found", lambda x: x["span"]).alias("found"))
    return out.select("doc_id", "n_hit", "n_words", "n_repeated", F.coalesce(F.array_join("found", " "), F.lit("")).alias("spans"))


def remove_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """docs with all its columns, each text without its repeated units (or repeated passages only), and ``removed``: the spans' original byte offsets.

    docs is written once, with a number for each row, which both its units and its text keep; a column of docs named
    removed is replaced.
    """
    names = [c for c in docs.columns if c != "removed"]
    numbered = materialise(docs.select(F.struct(*names).alias("doc"), F.monotonically_increasing_id().alias("row")), "docs")
    flat = numbered.select("row", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text"))
    spans = repeated_spans(flat, "id", "text", row_col="row").filter(F.col("passage") | F.lit(not passages))
    cuts = spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    joined = numbered.join(cuts, numbered["row"] == cuts["rid"], "left").select("doc.*", "removed")
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            out = []
            for text, spans_ in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                pos, parts = 0, []
                for s in spans_ or ():
                    parts.append(text[pos : s["start"]])
                    pos = s["end"]
                out.append(None if text is None else b"".join([*parts, text[pos:]]))
            yield b.set_column(at, b.schema.field(at), pa.array(out, pa.binary() if pa.types.is_string(b.column(at).type) else pa.large_binary()).view(b.column(at).type))

    return joined.mapInArrow(run, joined.schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
