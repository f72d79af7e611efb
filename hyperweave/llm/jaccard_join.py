"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct five-word shingles as 64-bit hashes. Under one order of all shingles, two sets
whose Jaccard similarity is 0.8 or more share at least l shingles among the first ``n - ceil(0.8 n) + l`` of either
one, for every l. Each document picks the l that makes its estimated cost least: a longer prefix is more to send, but
asks more matches of a partner before it is verified. Of a pair, the smaller l counts.

Frequent shingles come last in the order, so that a passage that many documents share is in no prefix but of documents
that hold little else. Frequencies are counted over all documents, block by block; those under a block's floor are
lost, which changes the order, never the result. The list of frequent shingles has a fixed bound.

Steps, each of whose tables is written to the shared folder:
1. frequent shingles; 2. one row per document with its size, its set's digest and its prefix; 3. documents of equal
sets become one class; 4. classes meet at the shingles of their prefixes. At a shingle with few classes, pairs are
emitted, and those that met often enough are candidates; at one with many, no pairs are: the classes go to the unit of
the first of them. Shingles that ``HOT`` documents or more are known to hold meet nobody in one task: their first class
is an aggregate that is joined back. 5. Candidates go to the unit of a common neighbour with bitmaps of their sets, which bound what
two sets differ in from below; a unit splits into the groups that the bound leaves together. 6. Texts of such groups
are sent there, and links within are verified exactly, unless the two are linked already; a group emits a spanning
forest of its links. 7. A neighbourhood that is too large for a unit is dealt into blocks, and ``PIVOTS`` of its
members go to each block; so one that is a family of near copies becomes one component. What is not in its largest
component then meets all others of the neighbourhood, in pairs of blocks. 8. Connected components of the links.

Scale: shuffles hold the prefixes (about a fifth of all shingles), then the texts of candidates only. No group is
collected: posting lists are streamed, and units are bounded by documents and by shingles (``UNIT_DOCS``,
``UNIT_SHINGLES``), so by bytes of text; one pair of longer texts is a unit. The work for a large family of near copies
grows with its size; pairs of blocks are left to the members that are outside its largest component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.llm import textkernel
from hyperweave.llm.common import Scratch, parts, shuffle_partitions, table, trimmed
from hyperweave.llm.components import components

PER_CENT = 80
BLOCK_FLOOR, FREQUENT_FLOOR, FREQUENT_MAX = 4, 16, 1 << 18
LIST_PAIRS, UNIT_DOCS, UNIT_SHINGLES, PIVOTS, HOT = 32, 2048, 1 << 20, 16, 4096
VERIFY_COST, CHANCE_HITS, FEW = 4.0, 0.1, 8
FILTER_BITS = 1 << 24
U = np.uint64


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order of their hashes, documents counted for each): at most ``FREQUENT_MAX``, the most frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            texts = batch.column(0)
            for i, s in enumerate(textkernel.shingle_sets(texts)):
                held.append(s)
                size += len(s)
                if size > 1 << 19 or i == len(texts) - 1:
                    values, n = np.unique(np.concatenate(held), return_counts=True)
                    often = n >= BLOCK_FLOOR
                    yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["shingle", "n"])
                    held, size = [], 0

    counted = docs.select("text").mapInArrow(trimmed(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= FREQUENT_FLOOR).orderBy(F.desc("n"), "shingle").limit(FREQUENT_MAX).toPandas()
    values = top["shingle"].to_numpy(np.int64).view(U)
    order = np.argsort(values)
    return values[order], top["n"].to_numpy(np.float64)[order]


def prefix(s: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(l, prefix, which of it are hot) of a sorted set: the first ``n - ceil(0.8 n) + l`` in the order of (frequency, hash)."""
    n = len(s)
    if not n:
        return 1, s, np.zeros(0, bool)
    base = n - -(-PER_CENT * n // 100)
    hits = np.full(n, CHANCE_HITS)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        known = frequent[at] == s
        if known.any():
            often = np.where(known, counts[at], 0.0)
            order = np.argsort(np.where(known, np.floor(np.log2(np.maximum(often, 1))), 0), kind="stable")
            s, hits = s[order], hits + often[order]
    matches = np.arange(1, max(1, min(base, n - base)) + 1)
    met = np.cumsum(hits)[base + matches - 1]
    best = int((base + matches + met + VERIFY_COST * met / matches).argmin()) + 1
    return best, s[: base + best].copy(), hits[: base + best] >= HOT


def _prefixes(docs: DataFrame, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((frequent, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, n_often = shared.value
        for batch in batches:
            yield from (of_part(part, often, n_often) for part in parts(batch, 1))

    def of_part(batch: pa.RecordBatch, often: np.ndarray, n_often: np.ndarray) -> pa.RecordBatch:
        sizes, firsts, seconds, matches, cold, hot, maps = [], [], [], [], [], [], []
        for s in textkernel.shingle_sets(batch.column(1)):
            l, p, is_hot = prefix(s, often, n_often)
            sizes.append(len(s))
            matches.append(l)
            cold.append(p[~is_hot])
            hot.append(p[is_hot])
            maps.append(bitmap(s).tobytes())
            # the sum and the exclusive or of mixed members tell equal sets
            firsts.append(int(textkernel.mix(s).sum(dtype=U)) if len(s) else 0)
            seconds.append(int(np.bitwise_xor.reduce(textkernel.mix(s + U(0x9E3779B97F4A7C15)))) if len(s) else 0)

        def lists(some: list[np.ndarray]) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, some)]).astype(np.int32)), pa.array(np.concatenate([*some, np.empty(0, U)]).view(np.int64)))

        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(firsts, U).view(np.int64)), pa.array(np.array(seconds, U).view(np.int64)),
            pa.array(matches, pa.int32()), lists(cold), lists(hot), pa.array(maps, pa.binary()),
        ], names=["doc_id", "n_shingles", "d1", "d2", "matches", "prefix", "hot", "bits"])

    return docs.mapInArrow(trimmed(run), "doc_id long, n_shingles long, d1 long, d2 long, matches int, prefix array<long>, hot array<long>, bits binary")


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams (shingle, doc, size, matches), sorted by shingle and doc. Short lists give pairs (kind 0: a < b, the matches
    asked), long ones their members (kind 1: the list's first doc, doc). Pairs whose sizes exclude a link are left out."""

    def out(kind: int, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), pa.array(need.astype(np.int32))], names=["kind", "a", "b", "need"])

    def lists(c: list[np.ndarray], begins: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        long = np.repeat(lengths > LIST_PAIRS, lengths)
        if long.any():
            yield out(1, np.repeat(c[1][begins], lengths)[long], c[1][long], np.zeros(long.sum()))
        c = [x[~long] for x in c]
        for step in range(1, LIST_PAIRS):
            if len(c[0]) <= step:
                break
            i = np.flatnonzero(c[0][step:] == c[0][:-step])
            if not len(i):
                break
            j = i + step
            small, large = np.minimum(c[2][i], c[2][j]), np.maximum(c[2][i], c[2][j])
            keep = 100 * small >= PER_CENT * large
            i, j = i[keep], j[keep]
            yield out(0, c[1][i], c[1][j], np.minimum(c[3][i], c[3][j]))

    rest: list[np.ndarray] | None = None
    streaming = first = None  # a long list's shingle and first doc; its members go out as they come
    for batch in batches:
        c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if rest is not None:
            c = [np.concatenate([x, y]) for x, y in zip(rest, c)]
        fresh = np.ones(len(c[0]), bool)
        fresh[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])
        c = [x[fresh] for x in c]
        if streaming is not None:
            same = c[0] == streaming
            if same.any():
                yield out(1, np.full(same.sum(), first), c[1][same], np.zeros(same.sum()))
            if not same.all():
                streaming = None
            c = [x[~same] for x in c]
        if not len(c[0]):
            rest = None
            continue
        begins = np.flatnonzero(np.concatenate([[True], c[0][1:] != c[0][:-1]]))
        last = begins[-1]
        if len(c[0]) - last > LIST_PAIRS:
            streaming, first = c[0][-1], c[1][last]
            yield out(1, np.full(len(c[0]) - last, first), c[1][last:], np.zeros(len(c[0]) - last))
            rest = None
        else:
            rest = [x[last:] for x in c]
        if last:
            yield from lists([x[:last] for x in c], begins[:-1], np.diff(begins))
    if rest is not None:
        yield from lists(rest, np.zeros(1, np.int64), np.array([len(rest[0])]))


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit is the parity of the members that fall on it: two bits or more for each member, up to 4096 in all."""
    words = min(64, max(4, 1 << (2 * len(s) // 64).bit_length()))
    odd = np.bincount((s & U(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def join_alike(self, known: np.ndarray) -> None:
        """Join those of the same known component."""
        first: dict[int, int] = {}
        for i, c in enumerate(known.tolist()):
            self.join(first.setdefault(c, i), i)

    def stars(self, ids: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
        """(smallest id of the tree, id) for each other id of each tree that is more than one known component."""
        roots = [self.find(i) for i in range(len(ids))]
        least: dict[int, int] = {}
        within: dict[int, set[int]] = {}
        for r, x, c in zip(roots, ids.tolist(), known.tolist()):
            least[r] = min(least.get(r, x), x)
            within.setdefault(r, set()).add(c)
        return sorted({(least[r], x) for r, x in zip(roots, ids.tolist()) if least[r] != x and len(within[r]) > 1})


def near_pairs(sizes: np.ndarray, bits: list[np.ndarray], forest: Forest) -> Iterator[tuple[int, list[int]]]:
    """Each i with later ones, not in its tree when it comes, whose bitmaps don't exclude a link; ``sizes`` ascend, none is 0.

    Sets are linked where 100 |both| >= 80 |either|, that is where (100 + 80) |difference| <= (100 - 80) (m + n).
    """
    folded: dict[int, np.ndarray] = {}
    for i in range(len(sizes)):
        end = int(np.searchsorted(sizes, sizes[i] * 100 // PER_CENT, "right"))
        if end <= i + 1:
            continue
        width = len(bits[i])
        if width not in folded:
            level = np.zeros((len(sizes), width), U)
            for j in range(i, len(sizes)):
                level[j] = np.bitwise_xor.reduce(bits[j].reshape(-1, width))
            folded[width] = level
        level = folded[width]
        apart = np.bitwise_count(level[i + 1 : end] ^ level[i]).sum(1, dtype=np.int64)
        near = (np.flatnonzero((100 + PER_CENT) * apart <= (100 - PER_CENT) * (sizes[i] + sizes[i + 1 : end])) + i + 1).tolist()
        tree = forest.find(i)
        near = [j for j in near if forest.find(j) != tree]
        if near:
            yield i, near


def groups_within(ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray]) -> list[tuple[int, int]]:
    """What the bitmaps leave together, beyond known components, as (smallest id of the group, other id)."""
    order = np.lexsort((ids, sizes))
    forest = Forest(len(ids))
    forest.join_alike(known[order])
    for i, near in near_pairs(sizes[order], [bits[i] for i in order], forest):
        for j in near:
            forest.join(i, j)
    return forest.stars(ids[order], known[order])


class Shared:
    """Sizes of what a set shares with others."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.places, self.marks = sets, None, None

    def sizes(self, i: int, others: list[int]) -> np.ndarray:
        if len(others) <= FEW:
            return np.array([self._search(i, j) for j in others], np.int64)
        if self.places is None:  # members are numbered once, then a set is marked and the others look theirs up
            numbers = np.unique(np.concatenate(self.sets), return_inverse=True)[1].astype(np.int32)
            self.places, self.marks = np.split(numbers, np.cumsum([len(s) for s in self.sets])[:-1]), np.zeros(int(numbers.max()) + 1, bool)
        self.marks[self.places[i]] = True
        found = self.marks[np.concatenate([self.places[j] for j in others])]
        self.marks[self.places[i]] = False
        ends = np.cumsum([len(self.sets[j]) for j in others])
        return np.add.reduceat(found, ends - [len(self.sets[j]) for j in others], dtype=np.int64)

    def _search(self, i: int, j: int) -> int:
        a, b = self.sets[i], self.sets[j]
        return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def links_within(ids: np.ndarray, known: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets and of known components, as (smallest id of the tree, id)."""
    order = np.array(sorted((i for i in range(len(ids)) if len(sets[i])), key=lambda i: (len(sets[i]), ids[i])), np.int64)
    ids, known, sets = ids[order], known[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets], np.int64)
    forest = Forest(len(ids))
    forest.join_alike(known)
    shared = Shared(sets)
    for i, near in near_pairs(sizes, [bitmap(s) for s in sets], forest):
        at, step = 0, 1
        while at < len(near):  # ever more at once: those that a link has joined meanwhile are left out
            tree = forest.find(i)
            some = [j for j in near[at : at + step] if forest.find(j) != tree]
            at, step = at + step, 2 * step
            if some:
                both = shared.sizes(i, some)
                for j in np.array(some)[100 * both >= PER_CENT * (sizes[i] + sizes[some] - both)].tolist():
                    forest.join(i, j)
    return forest.stars(ids, known)


def _members(met: DataFrame, hot: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """(near, doc_id, size): neighbourhoods. Every candidate pair is in one at least."""
    pairs = met.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("a", "b")
    pairs = scratch.write(pairs, "candidates")
    towards = pairs.groupBy("b").agg(F.min("a").alias("near")).withColumnRenamed("b", "a")
    around = pairs.join(towards, "a", "left").select(F.coalesce("near", "a").alias("near"), "a", "b")
    # long lists of one group of documents mostly begin with the same document, and fall together under it
    members = around.select("near", F.explode(F.array("a", "b")).alias("doc_id")).unionAll(met.where("kind = 1").select("a", "b")).unionAll(hot)
    return scratch.write(members.distinct().join(sizes, "doc_id").select("near", "doc_id", "size"), "members")


def _hot_members(hot: DataFrame) -> DataFrame:
    """(near, doc_id) of ``hot(shingle, rep)``: the first document of a shingle and each other. The firsts are rows for
    frequent shingles, so bounded by ``FREQUENT_MAX``."""
    first = hot.groupBy("shingle").agg(F.min("rep").alias("near"))
    return hot.join(F.broadcast(first), "shingle").select("near", F.col("rep").alias("doc_id"))


def _blocks(docs: str, size: str) -> Column:
    """Blocks of half a unit."""
    return F.ceil(F.greatest(F.col(docs) / (UNIT_DOCS // 2), F.col(size) / (UNIT_SHINGLES // 2))).cast("int")


def _dealt(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id"), blocks).cast("int")


def _units(members: DataFrame, wide: DataFrame) -> DataFrame:
    """(unit, doc_id, known): neighbourhoods, or blocks of ``wide(near, blocks)`` ones along with pivots of all blocks."""
    own = members.join(wide, "near", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", _dealt(F.col("blocks")))
    pivots = own.where((F.col("blocks") > 1) & (F.col("own") < PIVOTS)).groupBy("near", "blocks", "own").agg(F.min_by("doc_id", F.xxhash64("doc_id")).alias("doc_id"))
    pivots = pivots.select("near", "doc_id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("own <> other")
    placed = own.select("near", "doc_id", "own").unionAll(pivots.select("near", "doc_id", "other"))
    return placed.select(F.xxhash64("near", "own").alias("unit"), "doc_id", F.col("doc_id").alias("known"))


def _units_of_rest(members: DataFrame, wide: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(unit, doc_id, known) of what the links leave outside the largest component of its wide neighbourhood, in pairs of
    blocks with all others of it."""
    known = components(links).withColumnRenamed("node", "doc_id")
    inside = members.join(wide.select("near"), "near").join(known, "doc_id", "left").select("near", "doc_id", "size", F.coalesce("component", "doc_id").alias("known"))
    inside = scratch.write(inside, "inside")
    parts_of = inside.groupBy("near", "known").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    sizes = parts_of.groupBy("near").agg(F.max_by("known", F.struct("n", "known")).alias("main"), F.max(F.struct("n", "known", "size"))["size"].alias("s_main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.sum("size").alias("s"))
    sizes = sizes.where("n > n_main").withColumn("n_rest", F.col("n") - F.col("n_main")).withColumn("s_rest", F.col("s") - F.col("s_main")).select("near", "main", _blocks("n_main", "s_main").alias("mains"), _blocks("n_rest", "s_rest").alias("rests"))
    is_main = F.col("known") == F.col("main")
    own = inside.join(sizes, "near").withColumn("own", F.when(is_main, F.col("rests") + _dealt(F.col("mains"))).otherwise(_dealt(F.col("rests"))))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("rests")).otherwise(F.col("rests") + F.col("mains")) - 1)))
    return dealt.select(F.xxhash64("near", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "doc_id", "known")


def _links(units: DataFrame, full: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links within ``units(unit, doc_id, known)`` that connect different known components."""

    def split(rows: pa.Table) -> pa.Table:
        unit = rows["unit"][0].as_py()
        ids, known = rows["doc_id"].to_numpy(), rows["known"].to_numpy()
        found = groups_within(ids, known, rows["n_shingles"].to_numpy(), [np.frombuffer(b, U) for b in rows["bits"].to_pylist()])
        both, component = sorted({(a, x) for a, b in found for x in (a, b)}), dict(zip(ids.tolist(), known.tolist()))
        columns = [[unit] * len(both), [a for a, _ in both], [x for _, x in both], [component[x] for _, x in both]]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("unit", "first", "doc_id", "known"), columns)})

    bounded = units.join(full.select("doc_id", "n_shingles", "bits"), "doc_id").groupBy("unit").applyInArrow(split, "unit long, first long, doc_id long, known long")
    groups = scratch.write(bounded.select(F.xxhash64("unit", "first").alias("unit"), "doc_id", "known"), "groups")
    texts = _wanted_texts(docs.where("doc_id IS NOT NULL"), groups).join(groups, "doc_id")

    def verify(rows: pa.Table) -> pa.Table:
        found = links_within(rows["doc_id"].to_numpy(), rows["known"].to_numpy(), list(textkernel.shingle_sets(rows["text"].combine_chunks())))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return scratch.write(texts.groupBy("unit").applyInArrow(verify, "a long, b long"), "links")


def _marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` with ``marked``: true for every doc_id of ``wanted``, and for few others. A bitmap of fixed size."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    cells = wanted.select(bit("doc_id").alias("bit")).groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
    found = docs.withColumn("bit", bit("doc_id")).withColumn("cell", F.shiftright("bit", 6)).join(F.broadcast(cells), "cell", "left")
    return found.withColumn("marked", F.expr("bits IS NOT NULL AND (shiftrightunsigned(bits, cast(bit & 63 as int)) & 1L) = 1L")).drop("bit", "cell", "bits")


def _wanted_texts(docs: DataFrame, units: DataFrame) -> DataFrame:
    """``docs`` without most of those that no unit wants, before the join proper."""
    return _marked(docs, units).where("marked").select("doc_id", "text")


def _without_copies(full: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``full`` that stand for their class. Only rows that may be copies are shuffled with their prefixes (an
    anti join would be pushed below the bitmap, and shuffle all)."""
    keys = ["d1", "d2", "n_shingles", "doc_id"]
    copies = scratch.write(full.select(keys).join(classes, keys[:3]).where("doc_id <> rep").select(keys).distinct(), "copies")
    marked = _marked(full.drop("bits"), copies)
    sure, open_ = marked.where("NOT marked"), marked.where("marked")
    return sure.unionAll(open_.join(copies.withColumn("copy", F.lit(True)), keys, "left").where("copy IS NULL").select(sure.columns)).drop("marked")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: documents linked by a Jaccard similarity of 0.8 or more, directly
    or through others, have the smallest doc_id among them as component.

    ASCII letters are lower-cased; words are runs of other characters than ASCII white space. A text of one to four
    words has one shingle, all of it. Null and empty texts have none and are linked with nothing. A row with a null id
    takes no part and gets a null component. Repeated rows come back as
    often. An id is taken to name one text; where it names several, classes whose smallest id it is count as one. Ties cannot matter: 0.8 exactly is a link.
    Other columns are not read. Very long texts are read whole. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = _docs(docs, id_col, text_col)
    with Scratch(spark) as scratch:
        table1 = scratch.write(_prefixes(docs, *frequent_shingles(docs)), "prefixes", keep=True)
        full = table1.where("n_shingles > 0 AND doc_id IS NOT NULL")
        classes = scratch.write(full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes", keep=True)
        reps = _without_copies(full, classes, scratch).select(F.col("doc_id").alias("rep"), F.col("n_shingles").cast("int").alias("size"), "matches", "prefix", "hot")
        postings = reps.select(F.explode("prefix").alias("shingle"), "rep", "size", "matches")
        met = postings.repartition(shuffle_partitions(spark), "shingle").sortWithinPartitions("shingle", "rep").mapInArrow(trimmed(meet), "kind byte, a long, b long, need int")
        hot = _hot_members(reps.where(F.size("hot") > 0).select(F.explode("hot").alias("shingle"), "rep"))
        sizes = full.groupBy("doc_id").agg(F.max("n_shingles").alias("size"))
        members = _members(scratch.write(met, "met"), hot, sizes, scratch)
        scratch.drop("met", "candidates", "copies")
        wide = members.groupBy("near").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where((F.col("n") > UNIT_DOCS) | (F.col("size") > UNIT_SHINGLES) & (F.col("n") > 2))
        wide = scratch.write(wide.select("near", _blocks("n", "size").alias("blocks")), "wide")
        links = _links(_units(members, wide), full, docs, scratch)
        if not wide.isEmpty():
            links = links.unionAll(_links(_units_of_rest(members, wide, links, scratch), full, docs, scratch))
        joined = components(links).select(F.col("node").alias("rep"), "component")
    out = table1.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2", "n_shingles"], "left").join(joined, "rep", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


# Words are joined by a space, which is in no word, so shingles of different words differ.
OP3_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= {PER_CENT} * (p.n + q.n - shared)),
reach(doc_id, far) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON far = a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(far) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
