"""Near copies by word shingles: candidates of a SimHash index and of prefix-filtered posting lists, verified by exact Jaccard similarity, then components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import lookup, materialise, release, unit_hash
from tessera.llm.components import components
from tessera.llm.simhash import majority, near_links

#: Words of a shingle, and the least similarity of two near copies in percent.
SHINGLE_WORDS, SIMILAR = 5, 80
SEED = 42
#: Common shingles are told from about so many texts, and listed up to so many. They only order the shingles: no pair depends on it.
ORDER_TEXTS, ORDER_SHINGLES, COMMON = 40_000, 1 << 20, 3
#: Posting lists are taken for long if so many texts of the sample have the shingle.
LONG_LIST = 50
#: Sets of lists up to this length meet in pairs. Those of longer ones are indexed again, by how common shingles are among them.
SHORT_LIST = 64
#: Rounds in which each set of lists that are long even then meets the one with the nearest sketch, before they meet in
#: pairs, as long as there would be more pairs than PAIRS_A_SET for each set; pairs with sketches too far apart don't count.
#: A pair counts once, though it meets in many lists, unless there are REPEATS times as many with all repeats.
NEAREST_ROUNDS, PAIRS_A_SET, REPEATS = 3, 4, 16
#: Pairs of a list that a task gathers before it sends them.
PAIRS_AT_ONCE = 1 << 19
#: Pairs of one set that meet it in one task.
HUB_PAIRS = 4096
#: Bits of a set's parity sketch, and sets of a list that meet one another in one task; longer lists meet in blocks.
SKETCH_BITS, LIST_BLOCK = 2048, 4096
#: Up to so many names of candidates are broadcast to the texts.
BROADCAST_ROWS = 1 << 20


def shingle_set(text: bytes | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of the shingles of a text; fewer words make one shingle, a blank text none."""
    own = (text or b"").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    shingles = map(join, zip(*(own[k:] for k in range(words)), strict=False)) if len(own) >= words else [join(own)]
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), np.uint64))


def sketch(own: np.ndarray) -> bytes:
    """A bit for each residue of hashes: whether an odd number of them has it.

    Two sketches differ in no more bits than the sets do in members, so a pair whose sketches differ too much is none.
    """
    odd = np.bincount((own & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def prefix_size(n: int, similar: int = SIMILAR) -> int:
    """So many first shingles of n, in an order common to all sets, hold one of any set that is similar enough."""
    return n - -(-similar * n // 100) + 1 if n else 0


def _common(texts: DataFrame, words: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that so many texts (column text) have at least, the most frequent ORDER_SHINGLES, ascending, and their counts."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                sets = [shingle_set(t, words) for t in b.column(0).slice(i, 1024).cast(pa.binary()).to_pylist()]
                keys, counts = np.unique(np.concatenate(sets).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], ["key", "n"])

    found = texts.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    top = found.orderBy(F.desc("n"), "key").limit(ORDER_SHINGLES).toArrow()
    keys, counts = top["key"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _prefixed(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], words: int, similar: int) -> DataFrame:
    """(doc_id, named, node, size, fp, sketch, prefix) of each row: texts with the same shingles are one node; named is the text's hash, fp the SimHash of its shingles.

    The prefix holds the rarest shingles, equally rare ones by their hash. Whole shingle sets aren't stored: they are
    several times the size of the texts, from which candidates' sets are made again.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        keys, counts = sent.value
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                nodes, sizes, fps, sketches, prefixes = [], [], [], [], []
                for t in part.column(2).cast(pa.binary()).to_pylist():
                    own = shingle_set(t, words)
                    nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                    sizes.append(len(own))
                    fps.append(majority(own))
                    sketches.append(sketch(own))
                    own = own.view(np.int64)
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                        own = own[np.lexsort((own, np.where(keys[at] == own, counts[at], 0)))]
                    prefixes.append(own[: prefix_size(len(own), similar)].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), pa.array(prefixes, pa.binary())], ["doc_id", "named", "node", "size", "fp", "sketch", "prefix"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, named bigint, node bigint, size int, fp bigint, sketch binary, prefix binary")


def _posts(prefixes: DataFrame, hot: np.ndarray | None = None, inside: bool = False) -> DataFrame:
    """(key, node, size, left) of the prefix (node, size, prefix) of each node; left counts the shingle and those after it.

    With hot, ascending shingles, only those that are among them (inside) or aren't.
    """
    sent = None if hot is None else prefixes.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                keys = [np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()]
                counts, sizes = [len(k) for k in keys], part.column(1).to_numpy()
                left = np.concatenate([n - np.arange(c) for n, c in zip(sizes.tolist(), counts, strict=True)])
                posts = [np.concatenate(keys), np.repeat(part.column(0).to_numpy(), counts), np.repeat(sizes, counts), left.astype(np.int32)]
                if sent is not None:
                    is_hot = np.zeros(len(posts[0]), bool)
                    if len(sent.value):
                        is_hot = sent.value[np.minimum(np.searchsorted(sent.value, posts[0]), len(sent.value) - 1)] == posts[0]
                    posts = [x[is_hot == inside] for x in posts]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in posts], ["key", "node", "size", "left"])

    return prefixes.filter("size > 0").select("node", "size", "prefix").mapInArrow(run, "key bigint, node bigint, size int, left int")


class _Law:
    """What two sets with a similarity of ``similar`` percent or more can't do without."""

    def __init__(self, similar: int):
        self.similar = similar

    def meet(self, a: str, b: str):
        """Whether a shingle can be the first that two similar sets share: what is left in either set from it on must do."""
        return (100 + self.similar) * F.least(f"{a}.left", f"{b}.left") >= self.similar * (F.col(f"{a}.size") + F.col(f"{b}.size"))

    def near(self, differ: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether sets of n and m shingles that differ in so many, or in more, can be similar."""
        return (100 + self.similar) * differ <= (100 - self.similar) * (n + m)

    def leads(self):
        """Whether a shingle can be the first that a set shares with one of its size or larger; without such a set a list has no pairs."""
        return (100 + self.similar) * F.col("left") >= 2 * self.similar * F.col("size")

    def share(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """So many shingles of their prefixes sets of n and m shingles share at least.

        They share ``both`` shingles. Of the set whose prefix ends first, all but those beyond it are shared within both prefixes.
        """
        both = -(-self.similar * (n + m) // (100 + self.similar))
        beyond = [-(-self.similar * k // 100) - 1 for k in (n, m)]
        return np.maximum(1, np.minimum(both - beyond[0], both - beyond[1]))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Numbers that stand in both of two arrays without repeats."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _plausible(pairs: DataFrame, groups: DataFrame, law: _Law, total: int) -> DataFrame:
    """The pairs (a, b) whose prefixes share as many shingles as those of similar sets do at least."""
    prefixes = groups.select("node", "size", "prefix")
    if total <= BROADCAST_ROWS // 2:  # checked; else all prefixes are shuffled to the pairs
        prefixes = prefixes.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")
    hubs = pairs.groupBy("a").agg(F.count("*").alias("n")).join(prefixes.withColumnsRenamed({"node": "a", "size": "size_a", "prefix": "prefix_a"}), "a")
    sides = lookup(pairs.select("a", "b"), hubs, "a", "n", "b", total).join(prefixes.withColumnsRenamed({"node": "b", "size": "size_b", "prefix": "prefix_b"}), "b")

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                own = [[np.frombuffer(x, np.int64) for x in batch.column(k).to_pylist()] for k in (4, 5)]
                shared = np.array([_shared(x, y) for x, y in zip(*own, strict=True)])
                keep = shared >= law.share(*(batch.column(k).to_numpy().astype(np.int64) for k in (2, 3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sides.select("a", "b", "size_a", "size_b", "prefix_a", "prefix_b").mapInArrow(run, "a bigint, b bigint")


def _texts(nodes: DataFrame, groups: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the nodes, one text of each."""
    asked = materialise(nodes.distinct().join(groups.select("node", "named"), "node"), "asked")
    if asked.count() <= BROADCAST_ROWS:  # checked; else the texts are shuffled to the names
        asked = F.broadcast(asked)
    return docs.select("named", "text").join(asked, "named").select("node", "text").dropDuplicates(["node"])


def _similar(pairs: DataFrame, texts: DataFrame, words: int, similar: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough.

    A pair carries the text of b; the text of a comes once to each task that has pairs of it, HUB_PAIRS pairs at a time.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("salts"))
    dealt = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b").join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
    hubs = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(texts.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("bigint").alias("b"), "text")

    def run(batches):
        hub = None
        for whole in batches:
            for i in range(0, whole.num_rows, 256):  # a batch's texts aren't copied at once
                batch, a, b = whole.slice(i, 256), [], []
                for x, y, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                    own = shingle_set(text, words)
                    if y is None:
                        hub = own
                        continue
                    shared = _shared(hub, own)
                    if 100 * shared >= similar * (len(hub) + len(own) - shared):
                        a.append(x), b.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return hubs.unionByName(dealt).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(run, "a bigint, b bigint")


def _open(posts: DataFrame, roots: DataFrame, total: int) -> DataFrame:
    """(key, node, size, left, root) of posting lists that hold more than one component; the others need no comparison any more."""
    rest = posts.select("key", "node", "size", "left").join(roots, "node", "left").select("key", "node", "size", "left", F.coalesce("root", "node").alias("root"))
    many = rest.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key", "n")
    return materialise(lookup(rest, many, "key", "n", "node", total).filter("n is not null"), "posts")


class _Search:
    """Links found so far, and pairs that needn't be looked at again."""

    def __init__(self, groups: DataFrame, docs: DataFrame, words: int, similar: int):
        self.groups, self.docs, self.words, self.law = groups, docs, words, _Law(similar)
        self.links = self.tried = groups.sparkSession.createDataFrame([], "a bigint, b bigint")
        self.kept: list[DataFrame] = []

    def verify(self, pairs: DataFrame) -> None:
        """Adds the links among pairs (a, b), of which a stands for many."""
        before = self.tried.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        pairs = pairs.select("a", "b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).dropDuplicates(["lo", "hi"]).join(before, ["lo", "hi"], "left_anti").select("a", "b")
        pairs = materialise(pairs, "pairs")
        likely = materialise(_plausible(pairs, self.groups, self.law, max(1, pairs.count())), "likely")
        texts = materialise(_texts(likely.select(F.explode(F.array("a", "b")).alias("node")), self.groups, self.docs), "texts")
        links = materialise(_similar(likely, texts, self.words, self.law.similar), "links")
        release(texts, likely)
        self.kept += [links, pairs]
        self.links, self.tried = self.links.unionByName(links), self.tried.unionByName(pairs)

    def in_pairs(self, rest: DataFrame, nearest: bool = False) -> DataFrame:
        """(a, b) of the sets of a list that are in different components, can have their first shared shingle there, and whose sketches are near.

        A task takes one list, or two blocks of a long one, after another: only the pairs that are left become rows; with
        nearest, only that of each set and the one with the nearest sketch, so at most a row for each set of a list or block.
        """
        law = self.law
        return self._dealt(rest).mapInArrow(lambda batches: _near_pairs(batches, law, nearest), "a bigint, b bigint")

    def few(self, rest: DataFrame, most: int) -> DataFrame | None:
        """The different ones of in_pairs, if there are so many at most; tasks only send the numbers of pairs before that is sure to be so."""
        law = self.law
        number = self._dealt(rest).mapInArrow(lambda batches: _number(_near_pairs(batches, law)), "n bigint").agg(F.sum("n")).first()[0]
        if (number or 0) <= REPEATS * most and (found := materialise(self.in_pairs(rest).distinct(), "near")).count() <= most:
            return found
        return None

    def _dealt(self, rest: DataFrame) -> DataFrame:
        """The sets of lists with their sketches, those of a list, or of two blocks of it, one after another in one task."""
        blocks, own = F.ceil(F.col("n") / LIST_BLOCK).cast("int"), F.col("own")
        dealt = rest.withColumns({"own": F.pmod(F.xxhash64("node"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
        dealt = dealt.select("key", F.least(own, "other").alias("lo"), F.greatest(own, "other").alias("hi"), "own", "node", "size", "left", "root")
        dealt = dealt.join(self.groups.select("node", "sketch"), "node").select("key", "lo", "hi", "own", "node", "size", "left", "root", "sketch")
        return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def _number(batches):
    """The rows of all batches."""
    yield pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in batches)], pa.int64())], ["n"])


def _near_pairs(batches, law: _Law, nearest: bool = False):
    """Sorted (key, lo, hi, own, node, size, left, root, sketch) batches to pairs (a, b), with nearest only each set's nearest; a list that goes on in the next batch is kept back until it is whole."""

    def rows(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def pairs(part: pa.Table):
        key, lo, hi, own, node, size, left, root = (part.column(k).to_numpy().astype(np.int64) for k in range(8))
        bits = np.frombuffer(b"".join(part.column(8).to_pylist()), np.uint64).reshape(len(key), -1)
        end = np.flatnonzero(_ends(key, lo, hi)) + 1
        end = np.repeat(end, np.diff(np.r_[0, end]))
        i, d, found, held = np.arange(len(key)), 0, [np.zeros((2, 0), np.int64)], 0
        least, other = np.full(len(key), 8 * bits.itemsize * bits.shape[1] + 1), np.full(len(key), -1)
        while len(i := i[i + (d := d + 1) < end[i]]):
            j = i + d
            can = (root[i] != root[j]) & ((lo[i] == hi[i]) | (own[i] != own[j])) & ((100 + law.similar) * np.minimum(left[i], left[j]) >= law.similar * (size[i] + size[j]))
            x, y = i[can], j[can]
            differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            near = law.near(differ, size[x], size[y])
            x, y, differ = x[near], y[near], differ[near]
            if nearest:
                for u, v in ((x, y), (y, x)):  # no set twice in u
                    less = differ < least[u]
                    least[u[less]], other[u[less]] = differ[less], v[less]
                continue
            found.append(np.stack([node[x], node[y]]))
            held += len(x)
            if held >= PAIRS_AT_ONCE:
                yield rows(found)
                found, held = [np.zeros((2, 0), np.int64)], 0
        x = np.flatnonzero(other >= 0)
        yield rows([*found, np.stack([node[x], node[other[x]]])])

    kept = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = part if kept is None else pa.concat_tables([kept, part]).combine_chunks()
        ends = np.flatnonzero(_ends(*(part.column(k).to_numpy() for k in range(3))))
        cut = int(ends[-2]) + 1 if len(ends) > 1 else 0
        if cut:
            yield from pairs(part.slice(0, cut))
        kept = part.slice(cut)
    if kept is not None and kept.num_rows:
        yield from pairs(kept)


def _ends(*columns: np.ndarray) -> np.ndarray:
    """Whether a row is the last of a run of rows with equal columns."""
    if not len(columns[0]):
        return np.zeros(0, bool)
    return np.r_[np.any([c[1:] != c[:-1] for c in columns], axis=0), True]


def _simhash_pairs(groups: DataFrame) -> DataFrame:
    """(a, b) that connect all nodes of groups (node, fp, size) whose fingerprints are equal or differ in simhash.MAX_BITS bits at most; blank texts aside."""
    nodes = groups.filter("size > 0").select("fp", "node")
    first = materialise(nodes.groupBy("fp").agg(F.count("*").alias("n"), F.min("node").alias("first")), "fingerprints")
    total = first.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    same = lookup(nodes, first, "fp", "n", "node", max(1, total[1])).filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    side = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}"))
    near = near_links(first.select("fp"), max(1, total[0])).join(side("a"), "a").join(side("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return same.unionByName(near)


def _lists(posts: DataFrame, law: _Law) -> DataFrame:
    """posts of lists that can hold a pair, with n, their length, and hub, the first set for which the shingle can be the first shared one."""
    by = Window.partitionBy("key")
    hub = F.min(F.when(law.leads(), F.struct("node", "size", "left")))
    return posts.withColumns({"n": F.count("*").over(by), "hub": hub.over(by)}).filter("n > 1 and hub is not null").drop("n")


def _links(groups: DataFrame, docs: DataFrame, common: tuple[np.ndarray, np.ndarray], words: int, similar: int) -> _Search:
    """The search whose ``links`` (a, b) connect all nodes that chains of similar pairs connect.

    Similar sets share a shingle of their prefixes, so they meet in its posting list; they can only meet where enough of
    both is left, and where a list has no set that could meet one of its size, it is dropped. First sets with near
    SimHash fingerprints meet, and each set of a list meets one of them. Sets of a short list that are still in different components then meet in pairs. Those of long
    lists (a family of texts from one template, say, or with one passage) are indexed again, by counts of shingles among
    them: what they have in common is then behind what is a text's own, so that sets which differ too much don't meet at
    all. In lists that are long even then each set meets its nearest of another component, a few times, before they meet
    in pairs, if too many different pairs would be left. Pairs whose sketches differ too much aren't made, those that share too few shingles of their prefixes
    aren't verified.
    """
    # Posting lists that the sample knows to be long are counted with partial sums, others by a window over each.
    search, hot = _Search(groups, docs, words, similar), common[0][common[1] >= LONG_LIST]
    cold, warm = _lists(_posts(groups, hot), search.law), _posts(groups, hot, inside=True)
    hub = F.min(F.when(search.law.leads(), F.struct("node", "size", "left"))).alias("hub")
    hubs = materialise(warm.groupBy("key").agg(F.count("*").alias("n"), hub).filter("n > 1 and hub is not null").drop("n"), "hubs")  # ORDER_SHINGLES rows at most
    posts = materialise(cold.unionByName(warm.join(F.broadcast(hubs), "key")), "posts")
    release(hubs)  # and the shuffle of all posts
    near = materialise(_simhash_pairs(groups), "near")
    met = posts.select("*", F.struct("size", "left").alias("own")).filter((F.col("hub.node") != F.col("node")) & search.law.meet("hub", "own"))
    search.verify(met.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).unionByName(near))
    release(near)
    roots = components(search.links, "a", "b")
    rest = _open(posts, roots, max(1, posts.count()))
    release(posts)
    pairs = search.in_pairs(rest.filter(F.col("n") <= SHORT_LIST))
    apart = materialise(rest.filter(F.col("n") > SHORT_LIST).select("node").distinct(), "apart")
    more, most = None, PAIRS_A_SET * apart.count()
    if most:
        texts = materialise(_texts(apart, groups, docs).select(F.lit(None).cast("bigint").alias("doc_id"), F.col("node").alias("named"), "text"), "texts")
        again = materialise(_prefixed(texts, _common(texts.select("text"), words, SHORT_LIST // 4), words, similar), "prefixes")
        posts = materialise(_lists(_posts(again), search.law).drop("hub"), "posts")
        release(texts, again)
        total = max(1, posts.count())
        more = _open(posts, roots, total)
        release(posts)
        pairs = pairs.unionByName(search.in_pairs(more.filter(F.col("n") <= SHORT_LIST))).unionByName(search.in_pairs(more.filter(F.col("n") > SHORT_LIST), nearest=True))
    search.verify(pairs)
    release(rest, apart)
    for r in range(1, NEAREST_ROUNDS + 1):
        if more is None or (long := more.filter(F.col("n") > SHORT_LIST)).isEmpty():
            break
        before, more = more, _open(long, components(search.links, "a", "b"), total)
        release(before)
        last = r == NEAREST_ROUNDS
        found = search.in_pairs(more) if last else search.few(more, most)
        search.verify(search.in_pairs(more, nearest=True) if found is None else found)
        if last or found is not None:
            break
    release(*([more] if more is not None else []))
    return search


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, node, component_id) for each row of docs; component_id is the smallest doc_id that links reach.

    A link is a pair of rows whose sets of ``words``-word shingles have a Jaccard similarity of ``similar`` percent or
    more; no such pair is lost. Blank and null texts are copies of one another. Null ids are no candidates for
    component_id; repeated ids give one row each. An empty docs gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("named"), F.col(text_col).cast("string").alias("text"))
    some = slim.filter(unit_hash("text") < ORDER_TEXTS / max(slim.count(), 1)).select("text").distinct()
    common = _common(some, words, COMMON)
    all_ = materialise(_prefixed(slim, common, words, similar), "prefixes")
    groups = materialise(all_.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.min("named").alias("named"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min("prefix").alias("prefix")), "nodes")
    rows = materialise(all_.select("doc_id", "node"), "members")
    release(all_)
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    search = _links(groups, slim, common, words, similar)
    roots = components(search.links, "a", "b")
    joined = groups.select("node", "n", "least").join(roots, "node", "left").select("node", "n", "least", F.coalesce("root", "node").alias("root"))
    labels = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = materialise(joined.join(labels, "root").select("node", "n", "component_id"), "labels")
    release(groups, *search.kept)
    out = materialise(lookup(rows, labelled, "node", "n", "doc_id", total).select("doc_id", "node", "component_id"), "near")
    release(rows, labelled)
    return out
