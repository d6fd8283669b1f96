"""SimHash near-duplicates: fingerprints, a byte-position index with count filtering, and components."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lookup, materialise, table
from tessera.llm.components import components

SHINGLE_WORDS, SEED, MAX_BITS, BYTES = 3, 42, 3, 8
#: Pairs of fingerprints within MAX_BITS share at least so many of the eight positional bytes.
MIN_SHARED = BYTES - MAX_BITS
#: Shingles whose bits are tallied at once.
CHUNK = 1 << 16
#: Posting lists longer than this are indexed again, by MIN_SHARED bytes.
LONG_LIST = 4096
#: Buckets up to this size are compared by sweeping offsets, larger ones by growing components from seeds.
SMALL_BUCKET = 48


def majority(hashes: np.ndarray) -> int:
    """64 bits: a bit is 1 if set in over half the hashes; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, BYTES)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the 3-word shingles (repeats included) of the whole text: a bit is 1 if set in over half the hashes.

    Fewer than three words make one shingle; null, empty or blank text gives 0.
    """
    words = (text or b"").lower().split()  # splits at space and \t to \r only
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    shingles = map(join, zip(words, words[1:], words[2:], strict=False)) if len(words) >= SHINGLE_WORDS else [join(words)]
    return majority(np.fromiter((digest(s, SEED) for s in shingles), np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; fp holds the 64 bits as a signed long. Map-side; memory is that of one batch of texts."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t) for t in b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def covering(width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions such that any MIN_SHARED positions hold one of them: the index loses no pair."""
    wanted, out = set(combinations(range(BYTES), MIN_SHARED)), []
    pool = list(combinations(range(BYTES), width))
    while wanted:
        best = max(pool, key=lambda s: sum(set(s) <= set(w) for w in wanted))
        out.append(best)
        wanted = {w for w in wanted if not set(best) <= set(w)}
    return out


def key_width(n: int) -> int:
    """Bytes in a posting key, so that a posting list of evenly spread fingerprints stays short at any n."""
    return next((w for w in (2, 3, 4) if n <= 64 << (8 * w)), MIN_SHARED)


def _linked(x: np.ndarray) -> np.ndarray:
    """For xor values: the positional bytes shared reach the minimum, and the bits that differ are few enough."""
    shared = sum((((x >> np.uint64(8 * k)) & np.uint64(255)) == 0).view(np.int8) for k in range(BYTES))
    return (shared >= MIN_SHARED) & (np.bitwise_count(x) <= MAX_BITS)


def _grow(fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of one bucket: each fingerprint reached is compared only with those not reached yet."""
    out, left = [], np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        root = queue[0]
        while queue and len(left):
            near = _linked(fps[left] ^ fps[queue.pop()])
            found, left = left[near], left[~near]
            out += [(root, i) for i in found.tolist()]
            queue += found.tolist()
    return out


def bucket_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key: all pairs of small buckets, spanning links of large ones."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [], []
    small = np.repeat(sizes <= SMALL_BUCKET, sizes)
    k, f = keys[small], fps[small]
    for d in range(1, min(SMALL_BUCKET, len(k))):
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        hit = same[_linked(f[same] ^ f[same + d])]
        a.append(f[hit]), b.append(f[hit + d])
    for s, n in zip(starts[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
        if len(found := np.array(_grow(fps[s : s + n]))):
            a.append(fps[s + found[:, 0]]), b.append(fps[s + found[:, 1]])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _compare(batches):
    """Sorted (key, fp) batches to links; a bucket that goes on in the next batch is kept back until it is whole."""
    keep_k, keep_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(k, f):
        a, b = bucket_links(k, f)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        k = np.r_[keep_k, batch.column(0).to_numpy()]
        f = np.r_[keep_f, batch.column(1).to_numpy().view(np.uint64)]
        cut = np.searchsorted(k, k[-1]) if len(k) else 0
        keep_k, keep_f = k[cut:], f[cut:]
        yield out(k[:cut], f[:cut])
    yield out(keep_k, keep_f)


def _key(number: int, positions: tuple[int, ...]):
    key = F.lit(number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
    return key


def near_links(distinct: DataFrame, n: int, width: int | None = None, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b) links that connect all fingerprints of ``distinct`` (column fp, no repeats) within MAX_BITS of one another.

    Posting lists of more than long_list fingerprints aren't compared as they are: their fingerprints are posted again
    under each set of MIN_SHARED positions that holds the list's own. A linked pair shares such a set, so it meets there.
    """
    width = width or key_width(n)
    sets = covering(width)
    posted = distinct.select(F.explode(F.array(*[_key(i, p) for i, p in enumerate(sets)])).alias("key"), "fp")
    if width < MIN_SHARED:
        # Lists of over long_list rows: as many as the rows of the index hold at most, so they are looked up, not collected.
        sizes = posted.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > long_list)
        sized = materialise(lookup(posted, sizes, "key", "size", "fp", len(sets) * n), "postings")
        short = sized.filter("size is null").select("key", "fp")
        wide = list(combinations(range(BYTES), MIN_SHARED))
        again = F.element_at(F.array(*[F.array(*[_key(len(sets) + j, w) for j, w in enumerate(wide) if set(p) <= set(w)]) for p in sets]), F.shiftrightunsigned("key", 8 * width).cast("int") + 1)
        long = sized.filter("size is not null").select(F.explode(again).alias("key"), "fp").distinct()
        posted = short.unionByName(long)
    dealt = posted.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_compare, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the smallest doc_id that links reach.

    Equal fingerprints are one node, so a group of copies costs one row; the index holds distinct fingerprints only.
    Null ids are no candidates for component_id (a component of null ids only has null); repeated ids give one row
    each. An empty docs gives no rows. Other columns of docs are not touched.
    """
    rows = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = materialise(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "distinct")
    counted = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = components(near_links(groups.select("fp"), counted[0]), "a", "b")
    joined = groups.join(roots, groups.fp == roots.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    labels = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = joined.join(labels, "root").select("fp", "n", "component_id")
    return lookup(rows, groups, "fp", "n", "doc_id", counted[1]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[[DataFrame, str, str], DataFrame] = near_groups) -> DataFrame:
    """The rows of docs, with all their columns, that stay: one document of each group, the one with the smallest id.

    Rows that share an id and stay are one document: one row of them is kept. Rows without an id can't be named by
    the decision and stay.
    """
    found = materialise(groups(docs, id_col, text_col).filter("doc_id is not null").select("doc_id", (F.col("doc_id") != F.col("component_id")).alias("goes")), "near")
    # The list of ids grows with the documents: always a shuffled hash join, which builds on the ids and sorts no texts.
    gone = found.filter("goes").select(F.col("doc_id").alias(id_col)).distinct().hint("shuffle_hash")
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    again = found.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(id_col))
    if again.isEmpty():
        return kept
    once = kept.join(again, id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col])
    return kept.join(again, id_col, "left_anti").select(*docs.columns).unionByName(once)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
