"""Conversation repair: Dijkstra on the lattice of (turn index, grammar state), cheapest edits first, ties by their letters."""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lookup, materialise, table

#: Rows, and bytes of text, of a conversation that a task holds at once; longer ones are repaired in segments.
SEGMENT, SEGMENT_BYTES = 512, 32 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANK = " \t\n\x0b\f\r"

# The grammar (s?(ua)+)? over role initials: nothing yet, after a system turn, after a user's, after an assistant's.
STATES, ENDS = range(4), (0, 3)
NEXT = {(0, b"s"): 1, (0, b"u"): 2, (1, b"u"): 2, (2, b"a"): 3, (3, b"u"): 2}
#: The role that Rerole and Insert give in each state, the state after it, and the inserts that end a conversation there.
MADE, AFTER, TAIL = (b"user", b"user", b"assistant", b"user"), (2, 2, 3, 2), (0, 2, 1, 0)


def cheapest(rows: list[tuple[bytes, bool, bool]], entry: int = 0, whole: bool = True) -> dict[int, tuple[int, bytes]]:
    """{state: (cost, audit)} of the cheapest edits of rows (role initial, must go, truncated) from the entry state.

    Nodes are (rows done, state), made as they are reached; the heap's key is (cost, audit), so that the first arrival
    at a node is the cheapest and among those the ASCII-least. For a whole conversation the search stops at the first
    popped end node that the grammar accepts. For a segment every end state is wanted, and inserts stand before a row
    only, so that no audit of a segment is the beginning of another one.
    """
    heap, done, found = [(0, b"", 0, entry)], set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows):
            if not whole:
                found[state] = (cost, audit)
                continue
            if state in ENDS:
                return {state: (cost, audit)}
        else:
            initial, must_go, truncated = rows[i]
            heapq.heappush(heap, (cost + DELETE, audit + b"D", i + 1, state))
            if not must_go:
                if (to := NEXT.get((state, initial))) is not None:
                    heapq.heappush(heap, (cost + KEEP + TRUNCATED * truncated, audit + b"K", i + 1, to))
                heapq.heappush(heap, (cost + REROLE + TRUNCATED * truncated, audit + b"R", i + 1, AFTER[state]))
        heapq.heappush(heap, (cost + INSERT, audit + b"I", i, AFTER[state]))
    return found


class Edits:
    """Applies the letters of an audit to rows as they come; gives (edit, role, text, whether it is the row's) of what stays."""

    def __init__(self, audit: str, state: int = 0):
        self.letters, self.at, self.state = audit, 0, state
        self.end = len(audit.rstrip("I"))

    def _insert(self) -> list[tuple]:
        out = []
        while self.letters[self.at : self.at + 1] == "I":
            out.append(("I", MADE[self.state], b"", False))
            self.at, self.state = self.at + 1, AFTER[self.state]
        return out

    def take(self, role: bytes, text: bytes) -> list[tuple]:
        out = self._insert()
        edit, self.at = self.letters[self.at], self.at + 1
        if edit != "D":
            out.append((edit, role if edit == "K" else MADE[self.state], text, True))
            self.state = NEXT[self.state, role[:1]] if edit == "K" else AFTER[self.state]
        return out + (self._insert() if self.at == self.end else [])


class Digest:
    """SHA-256 of repaired rows, role:text, newline-joined."""

    def __init__(self):
        self.hash, self.first = hashlib.sha256(), True

    def add(self, kept: list[tuple]) -> None:
        for _, role, text, _ in kept:
            self.hash.update((b"" if self.first else b"\n") + role + b":" + text)
            self.first = False

    def hex(self) -> str:
        return self.hash.hexdigest()


class Faults:
    """Counts of faults, illegal neighbours and turns of a conversation, or a part of one, taken row by row."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.least = self.most = None

    def add(self, initial: bytes, turn: int | None, fault: int) -> None:
        self.blank, self.duplicate, self.truncated = self.blank + (fault == 1), self.duplicate + (fault == 2), self.truncated + (fault == 3)
        if turn is not None:
            self.distinct += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in (b"su", b"ua", b"au")
        self.last = initial

    def append(self, other: Faults) -> None:
        for name in ("blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if other.least is not None:
            self.distinct += other.distinct - (other.least == self.most)
            self.least, self.most = other.least if self.least is None else self.least, other.most
        if other.last is not None:
            self.illegal += other.illegal + (self.last is not None and self.last + other.first not in (b"su", b"ua", b"au"))
            self.first, self.last = other.first if self.first is None else self.first, other.last

    def report(self) -> dict:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


def _fault(blank: bool, seen: bool, truncated: bool) -> int:
    return 1 if blank else 2 if seen else 3 if truncated else 0


def _name(conv) -> bytes:
    return b"" if conv is None else b"=" + str(conv).encode()


def _identity(name: bytes, role: bytes, text: bytes) -> bytes:
    return hashlib.sha256(b"%d:%d:" % (len(name), len(role)) + name + role + text).digest()


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, digest string"
_FIELDS = [pa.field(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [pa.field("audit", pa.string()), pa.field("digest", pa.string())]
_PLACE = [pa.field("part", pa.int32()), pa.field("seq", pa.int64())]
_ROW = [pa.field("step", pa.int32()), pa.field("edit", pa.string())]


def _kept(row: dict, kept: list[tuple]) -> list[dict]:
    place = {c: row[c] for c in ("conv_id", "part", "seq") if c in row}
    return [place | {"what": 1, "step": k, "edit": edit, "turn": row["turn"] if own else None, "role": role, "text": text} for k, (edit, role, text, own) in enumerate(kept)]


def _repair(segment: int, conv_type: pa.DataType, want_rows: bool):
    """Arrow batches of sorted rows to batches of finished reports (what 0), repaired rows (what 1) and rows of conversations left open (what 2).

    The first and the last conversation of a partition may go on in its neighbours, and a long one doesn't fit the
    buffer: their rows pass through as they are.
    """
    schema = pa.schema([pa.field("what", pa.int32()), pa.field("conv_id", conv_type), pa.field("name", pa.binary()), *_PLACE, pa.field("turn", pa.int64()), pa.field("role", pa.binary()), pa.field("text", pa.binary()),
                        pa.field("blank_row", pa.bool_()), pa.field("cut_row", pa.bool_()), pa.field("copies", pa.int32()), pa.field("identity", pa.binary()), *_ROW, *_FIELDS])

    def whole(conv, rows) -> list[dict]:
        faults, seen, steps = Faults(), set(), []
        for r in rows:
            for _ in range(r["copies"]):
                fault = _fault(r["blank_row"], (r["role"], r["text"]) in seen, r["cut_row"])
                seen.add((r["role"], r["text"]))
                faults.add(r["role"][:1], r["turn"], fault)
                steps.append((r["role"][:1], fault in (1, 2), fault == 3))
        ((cost, audit),) = cheapest(steps).values()
        edits, digest, out = Edits(audit.decode()), Digest(), []
        for r in rows:
            kept = [x for _ in range(r["copies"]) for x in edits.take(r["role"], r["text"])]
            digest.add(kept)
            out += _kept(r, kept) if want_rows else ()
        return [*out, {"what": 0, "conv_id": conv, **faults.report(), "cost": cost, "audit": audit.decode(), "digest": digest.hex()}]

    def passed(r) -> dict:
        name = _name(r["conv_id"])
        return r | {"what": 2, "name": name, "identity": _identity(name, r["role"], r["text"])}

    def run(batches):
        conv, rows, held, open_, seq = None, None, 0, True, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                r["seq"], seq = seq, seq + 1
                if rows is None or r["conv_id"] != conv:
                    if rows is not None and not open_:
                        out += whole(conv, rows)
                    open_ = rows is None  # the first of the partition
                    conv, rows, held = r["conv_id"], [], 0
                if open_:
                    out.append(passed(r))
                    continue
                rows.append(r)
                held += len(r["text"])
                if len(rows) > segment or held > SEGMENT_BYTES:
                    out += map(passed, rows)
                    open_, rows = True, []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if rows:
            yield pa.RecordBatch.from_pylist(list(map(passed, rows)), schema)

    return run


def _segments(place: pa.Table) -> pa.Table:
    """The costs, letters and faults of one segment, for every state before and after it."""
    faults, steps = Faults(), []
    for r in sorted(place.to_pylist(), key=lambda r: r["seq"]):
        for k in range(r["copies"]):
            fault = _fault(r["blank_row"], k > 0 or r["seen"], r["cut_row"])
            faults.add(r["initial"], r["turn"], fault)
            steps.append((r["initial"], fault in (1, 2), fault == 3))
    found = [cheapest(steps, s, whole=False) for s in STATES]
    costs = [found[s][t][0] if t in found[s] else -1 for s in STATES for t in STATES]
    audits = [found[s][t][1] if t in found[s] else b"" for s in STATES for t in STATES]
    order = {a: n for n, a in enumerate(sorted(set(audits)))}
    row = {c: place.column(c)[0].as_py() for c in ("name", "part", "segment")} | {"costs": costs, "ranks": [order[a] for a in audits], "audits": [a.decode() for a in audits]}
    row |= {c: getattr(faults, c) for c in ("blank", "duplicate", "truncated", "illegal", "distinct", "first", "last", "least", "most")}
    return pa.Table.from_pylist([row], _SEGMENT)


_KEYS = [pa.field("name", pa.binary()), pa.field("part", pa.int32()), pa.field("segment", pa.int64())]
_SEGMENT = pa.schema([
    *_KEYS, pa.field("costs", pa.list_(pa.int64())), pa.field("ranks", pa.list_(pa.int32())), pa.field("audits", pa.list_(pa.string())),
    *[pa.field(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "distinct")], pa.field("first", pa.binary()), pa.field("last", pa.binary()), pa.field("least", pa.int64()), pa.field("most", pa.int64()),
])
_SEGMENT_SQL = "name binary, part int, segment bigint, costs array<bigint>, ranks array<int>, audits array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, distinct bigint, first binary, last binary, least bigint, most bigint"
_CHOSEN = pa.schema([*_KEYS, pa.field("entry", pa.int32()), pa.field("leave", pa.int32()), pa.field("tail", pa.int32()), *_FIELDS[:6]])
_CHOSEN_SQL = "name binary, part int, segment bigint, entry int, leave int, tail int, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def _choose(parts: pa.Table) -> pa.Table:
    """The states before and after each segment of one conversation; its last row has the report.

    Of each state, what counts is its cost and the place of its letters among those of the other states: letters of
    different states differ within a segment at the latest, where none begins another, so places decide all ties.
    """
    rows, faults = sorted(parts.to_pylist(), key=lambda r: (r["part"], r["segment"])), Faults()
    best, back = {0: (0, 0)}, []
    for r in rows:
        piece = Faults()
        vars(piece).update({c: r[c] for c in vars(piece)})
        faults.append(piece)
        reached: dict[int, tuple] = {}
        for s, (cost, place) in best.items():
            for t in STATES:
                if (more := r["costs"][4 * s + t]) >= 0:
                    reached[t] = min(reached.get(t, (float("inf"),)), (cost + more, place, r["ranks"][4 * s + t], s))
        order = {x: n for n, x in enumerate(sorted({x[1:3] for x in reached.values()}))}
        back.append({t: x[3] for t, x in reached.items()})
        best = {t: (x[0], order[x[1:3]]) for t, x in reached.items()}
    state = min(best, key=lambda t: (best[t][0] + INSERT * TAIL[t], best[t][1]))
    out, cost, tail = [], best[state][0] + INSERT * TAIL[state], TAIL[state]
    for r, b in zip(reversed(rows), reversed(back), strict=True):
        here = tail if r["last"] is not None else 0  # what is inserted at the end comes after a row
        out.append({"name": r["name"], "part": r["part"], "segment": r["segment"], "entry": b[state], "leave": state, "tail": here})
        state, tail = b[state], tail - here
    out[0] |= faults.report() | {"cost": cost}
    return pa.Table.from_pylist(out, _CHOSEN)


def _replay(want_rows: bool):
    """(name, digest) of each conversation, or its repaired rows, from sorted rows with their segment's letters; no text is held."""
    schema = pa.schema([pa.field("name", pa.binary()), *_PLACE, *_ROW, pa.field("turn", pa.int64()), pa.field("role", pa.binary()), pa.field("text", pa.binary()), pa.field("digest", pa.string())])

    def run(batches):
        place, name, digest, edits = None, None, None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["name"], r["part"], r["segment"]) != place:
                    place, edits = (r["name"], r["part"], r["segment"]), Edits(r["audit"], r["entry"])
                if r["name"] != name:
                    out += [{"name": name, "digest": digest.hex()}] if digest and not want_rows else []
                    name, digest = r["name"], Digest()
                kept = [x for _ in range(r["copies"]) for x in edits.take(r["role"], r["text"])]
                if want_rows:
                    out += [x | {"name": name} for x in _kept(r, kept)]
                else:
                    digest.add(kept)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if digest and not want_rows:
            yield pa.RecordBatch.from_pylist([{"name": name, "digest": digest.hex()}], schema)

    return run


def _join_segments(rows: DataFrame, segment: int, want_rows: bool) -> DataFrame:
    """Reports (or repaired rows) of conversations that no task has seen whole: segments are solved apart, then put together by their states."""
    here = F.floor(F.col("seq") / segment).cast("bigint")
    firsts = rows.filter("copies > 0").groupBy("identity").agg(F.min(F.struct("part", "seq")).alias("earliest"), F.count("*").alias("n")).filter("n > 1")
    slim = rows.select("name", "part", "seq", here.alias("segment"), "turn", F.substring("role", 1, 1).alias("initial"), "blank_row", "cut_row", "copies", "identity")
    marked = lookup(slim, firsts, "identity", "n", "seq", rows.count())
    marked = marked.withColumn("seen", F.coalesce(F.struct("part", "seq") != F.col("earliest"), F.lit(False))).drop("identity", "earliest")
    solved = materialise(marked.groupBy("name", "part", "segment").applyInArrow(_segments, _SEGMENT_SQL), "segments")
    chosen = solved.drop("audits").groupBy("name").applyInArrow(_choose, _CHOSEN_SQL)
    letters = F.concat(F.element_at("audits", F.col("entry") * 4 + F.col("leave") + 1), F.repeat(F.lit("I"), F.col("tail")))
    chosen = materialise(chosen.join(solved.select("name", "part", "segment", "audits"), ["name", "part", "segment"]).withColumn("audit", letters).drop("audits"), "chosen")
    dealt = rows.select("name", "part", "seq", here.alias("segment"), "turn", "role", "text", "copies").join(chosen.select("name", "part", "segment", "entry", "audit"), ["name", "part", "segment"])
    ids = rows.groupBy("name").agg(F.min("conv_id").alias("conv_id"))
    kind = "name binary, part int, seq bigint, step int, edit string, turn bigint, role binary, text binary, digest string"
    if want_rows:
        return ids.join(dealt.repartition("name", "part", "segment").sortWithinPartitions("name", "part", "seq").mapInArrow(_replay(True), kind), "name")
    # A digest is one chain over a conversation's bytes, so they pass through one task; sorted, they needn't be held.
    digests = dealt.repartition("name").sortWithinPartitions("name", "part", "seq").mapInArrow(_replay(False), kind).select("name", "digest")
    audits = chosen.groupBy("name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "segment", "audit"))), lambda x: x["audit"]), "").alias("audit"), *[F.max(f.name).alias(f.name) for f in _FIELDS[:6]]
    )
    return ids.join(audits, "name").join(digests, "name")


def prepared(turns: DataFrame, conv: str, turn: str, role: str, text: str, copies: Column) -> DataFrame:
    """Rows in one global order: range partitions by conversation, turn (nulls first) and MD5 of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    bare = F.rtrim("text", F.lit(BLANK))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("int").alias("copies"))
    rows = rows.withColumns({"blank_row": bare == "", "cut_row": ~F.right(bare, F.lit(1)).isin(".", "!", "?"), "tie": F.md5(F.concat_ws(":", "role", "text").cast("binary"))})
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "tie"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return ranged.select("conv_id", F.spark_partition_id().alias("part"), "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "blank_row", "cut_row", "copies")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """A row for each conversation: its faults, the cost and letters of its cheapest repair, and the repaired text's digest.

    ``copies`` says how many equal rows a row stands for (1); 0 only names its conversation. Turns are taken in order,
    nulls first; rows of the same turn by the MD5 of role and text, so that equal rows are neighbours. Null roles and
    texts are one space; a role whose initial is not s, u or a (an empty one too) fits nowhere as it is. Repeated rows
    are duplicates. A null conversation id is a conversation; an empty table gives no rows. Other columns aren't read.

    A conversation of up to ``segment`` rows is repaired by one search where it lies. A longer one, and one that the
    ranges cut, is solved in segments for every state before and after them, and the segments' states are chosen in
    turn: no task holds more than a segment's rows, or one short row for each segment of a conversation.
    """
    names = [f.name for f in _FIELDS]
    found = _searched(turns, conv, turn, role, text, copies, segment, False)
    return found.filter("what = 0").select("conv_id", *names).unionByName(_join_segments(found.filter("what = 2"), segment, False).select("conv_id", *names))


def repaired_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """The rows that ``repair`` leaves or inserts: conv_id, edit (K, R or I), turn (null if inserted), role and text.

    (part, seq, step) gives their order in the conversation.
    """
    found = _searched(turns, conv, turn, role, text, copies, segment, True)
    out = found.filter("what = 1").select("conv_id", *_OUT).unionByName(_join_segments(found.filter("what = 2"), segment, True).select("conv_id", *_OUT))
    return out.withColumns({"role": F.col("role").cast("string"), "text": F.col("text").cast("string")})


_OUT = ["part", "seq", "step", "edit", "turn", "role", "text"]


def _searched(turns: DataFrame, conv: str, turn: str, role: str, text: str, copies: Column | None, segment: int, want_rows: bool) -> DataFrame:
    kind = turns.schema[conv].dataType
    rows = prepared(turns, conv, turn, role, text, F.lit(1) if copies is None else copies)
    found = rows.mapInArrow(
        _repair(segment, _arrow(kind), want_rows),
        f"what int, conv_id {kind.simpleString()}, name binary, part int, seq bigint, turn bigint, role binary, text binary, blank_row boolean, cut_row boolean, copies int, identity binary, step int, edit string, {REPORT}",
    )
    return materialise(found, "conversations")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def damage(turns: DataFrame) -> DataFrame:
    """The rows with role and text as the damage leaves them and the number of copies; null values are one space."""
    space = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.pmod(F.crc32(F.concat(space["conv_id"], F.lit(":"), space["turn"]).cast("binary")), F.lit(20))
    text = F.when(fate == 1, "").when(fate == 2, F.translate(space["text"], ".!?", "")).otherwise(space["text"])
    role = F.when(fate == 4, "user").otherwise(space["role"])
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair(damage(table(spark, sf_dir, "conversations")), copies=F.col("copies"))
    return found.withColumnRenamed("digest", "repaired_sha256")
