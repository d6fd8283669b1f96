"""License scans: ordered signature rules behind a keyword filter; priority and containment settle overlaps."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import license_rules
from tessera.llm.common import table
from tessera.llm.decontaminate import _TO_SPACE

#: Words that a match spans at most; a rule is tried within so many words of its rarest keyword.
REACH = 64
#: Bytes that are split into words at once.
PIECE = 1 << 20

_MACROS = {
    "under": r"(?:licensed|released|distributed|available|published|provided|covered|redistribute it and or modify it|use it|is|are)(?: [^ ]+){0,2} under (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?",
    "tag": "spdx license identifier",
}


class Rule(NamedTuple):
    label: str
    words: tuple[bytes, ...]
    pattern: re.Pattern[bytes]
    priority: int
    base: bool


def _macro(found: re.Match) -> str:
    name = found[1]
    if name in _MACROS:
        return _MACROS[name]
    if name[0] == "~":
        return "(?: [^ ]+){0,%s}" % name[1:]
    first, _, rest = name[1:].partition(".")  # a version: <v2>, <v2.1>
    return f"(?:version |v ?)?{first} {rest}" if rest and rest[0] != "(" else f"(?:version |v ?)?{first}(?: 0)?"


def compiled(line: str, priority: int, base: bool = False) -> Rule:
    label, words, pattern = (x.strip() for x in line.split("|", 2))
    pattern = re.sub(r"<under> ", lambda m: _MACROS["under"], pattern)  # it ends in a space of its own
    pattern = re.sub(r"<([a-z~][^<>]*)>", _macro, pattern)
    return Rule(label, tuple(words.encode().split()), re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode()), priority, base)


RULES = [compiled(x, p) for p, lines in license_rules.CLASSES for x in lines.strip().splitlines()]
RULES += [compiled(x, license_rules.BASE_PRIORITY, base=True) for x in license_rules.BASE.strip().splitlines()]
#: Rules by their first keyword: no match without it.
BY_WORD: dict[bytes, list[int]] = {}
for _n, _rule in enumerate(RULES):
    BY_WORD.setdefault(_rule.words[0], []).append(_n)
KEYWORDS = frozenset(BY_WORD)
_ANCHOR = re.compile(rb"(?<![^ ])(?:" + b"|".join(sorted(KEYWORDS, key=len, reverse=True)) + rb")(?![^ ])")


class Hit(NamedTuple):
    rule: int
    start: int  # in words
    stop: int


def _windows(anchors: list[tuple[int, bytes]], n: int):
    """(first word, word after the last, anchor words) of the runs of words within reach of an anchor."""
    lo, hi, held = 0, -1, set()
    for at, word in anchors:
        if at - REACH > hi:
            if held:
                yield lo, hi, held
            lo, held = max(0, at - REACH), set()
        hi = min(n, at + REACH)
        held.add(word)
    if held:
        yield lo, hi, held


def matches(flat: bytes, starts: np.ndarray) -> list[Hit]:
    """All matches of all rules; flat has spaces between words, starts is the place of each word."""
    ends, out = np.append(starts[1:], len(flat)), []
    anchors = [(int(np.searchsorted(starts, m.start())), m[0]) for m in _ANCHOR.finditer(flat)]
    for lo, hi, held in _windows(anchors, len(starts)):
        words = flat[starts[lo] : ends[hi - 1]].split()
        known, text = set(words), b" ".join(words)
        places = np.cumsum([0, *(len(w) + 1 for w in words)])
        for n in sorted(r for w in held for r in BY_WORD[w]):
            rule = RULES[n]
            if known.issuperset(rule.words):
                for m in rule.pattern.finditer(text):
                    a, b = np.searchsorted(places, (m.start(), m.end() + 1))
                    out.append(Hit(n, lo + int(a), lo + int(b)))
    return out


def resolved(hits: list[Hit]) -> list[Hit]:
    """Hits that no better one contains: a higher priority, or the same priority and an earlier rule. Base rules always stay.

    Sorted by start, a container of a hit begins within REACH words before it.
    """
    rank = lambda h: (-RULES[h.rule].priority, h.rule)
    order, out, low = sorted(hits, key=lambda h: (h.start, -h.stop)), [], 0
    for k, h in enumerate(order):
        while order[low].start < h.start - REACH:
            low += 1
        if RULES[h.rule].base or not any(o.start <= h.start and o.stop >= h.stop and rank(o) < rank(h) for o in _around(order, low, k, h.start)):
            out.append(h)
    return out


def _around(order: list[Hit], low: int, k: int, start: int):
    """Those from low to k, and those that begin with k and are not longer."""
    yield from order[low:k]
    for o in order[k + 1 :]:
        if o.start > start:
            return
        yield o


def scan(text: bytes | None) -> tuple[int, list[tuple[Hit, int, int]]]:
    """(words, hits that stay with their first and last byte) of a whole text."""
    flat = (text or b"").translate(_TO_SPACE)
    n, at, hot = 0, 0, False
    while at < len(flat):  # pieces end between words
        end = flat.find(b" ", at + PIECE)
        words = flat[at : end if end >= 0 else len(flat)].split()
        n, hot, at = n + len(words), hot or not KEYWORDS.isdisjoint(words), end if end >= 0 else len(flat)
    if not hot:
        return n, []
    inside = np.frombuffer(flat, np.uint8) != 32
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    stops = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    return n, [(h, int(starts[h.start]), int(stops[h.stop - 1])) for h in resolved(matches(flat, starts))]


_HIT = pa.struct([("label", pa.string()), ("priority", pa.int32()), ("base", pa.bool_()), ("word", pa.int64()), ("n_words", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
HITS = "array<struct<label:string,priority:int,base:boolean,word:bigint,n_words:int,start:bigint,stop:bigint>>"


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, hits) for each row of docs: the label, priority, place in words and place in bytes of each detection.

    Map-side, whole texts, nothing is shuffled. A text is split into words by pieces; only where a rule's keyword
    occurs, the rules of that keyword are tried on the words around it. Null, empty and wordless texts have no hits;
    bytes that aren't UTF-8 are parts of words; repeated rows give a row each; an empty table gives no rows. Other
    columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [scan(t) for t in b.column(1).to_pylist()]
            hits = [[{"label": (r := RULES[h.rule]).label, "priority": r.priority, "base": r.base, "word": h.start, "n_words": h.stop - h.start, "start": s, "stop": e} for h, s, e in x] for _, x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(hits, pa.list_(_HIT))], ["doc_id", "n_words", "hits"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, f"doc_id {kind}, n_words bigint, hits {HITS}")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("hits", lambda h: h["base"])
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    word = F.transform("base", lambda h: h["word"])
    found = detections(table(spark, sf_dir, "documents")).withColumn("base", base)
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"), labels(F.col("base")).alias("base_labels"), labels(F.col("hits")).alias("labels"),
        (F.coalesce(F.array_max(F.transform("hits", lambda h: h["priority"])), F.lit(0)) / 100).alias("score"),
    )
