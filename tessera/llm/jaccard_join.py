"""N-gram Jaccard join by set relations: skip index blocks by position, derive answers from like sets.

A document's set is its distinct shingles of ``words`` words (4), as 64-bit hashes in sorted order. Two
documents link when 100 * intersection >= ``percent`` (85) * union; the result is the connected components of the links.

*Index lists by blocks of positions.* Linked sets of sizes s and t differ in at most 3 (s + t) / 37
elements (at 85 percent). Sets of about one size are cut, by hash value, into more blocks than that (a few more, see
below), so linked sets agree on a whole block. A block's content is the key of an index list: lists
of all blocks in which two sets differ are skipped without a look at their members. Sizes fall
into classes a factor of 100/85 apart; a set uses the cut of its own class and of the class below.
There are spare blocks beyond what the pigeonhole needs, and linked sets agree on one more than these.
A set leaves as many out: those with the fewest elements, by an order of contents common to all. The last
in that order on which linked sets agree has all others that they agree on before it, so both keep it. What
is left holds mostly two shingles and more; lists of one shingle would bring ever more sets together by chance, the larger the table.
A set with more empty blocks than spare ones also enters lists for the elements of its prefix, its first in
an order common to all, which linked sets of that sort must share. Shingles that are very common in a sample
of documents (common lines and passages) are left out of all blocks alike, which keeps the
argument intact and their lists short, and come last in prefixes; verification uses whole sets.

*Members of a list* are only chained to its smallest member: in a map task among its own rows, so
that a list leaves the task with one row, then among tasks. Chains make candidate components, which
hold every link; equal sets are one member from the start, however many documents have them.

*Search within a candidate component.* Shingles are numbered exactly, by their words, so no hash
decides a link. Each shingle has a list of the sets that hold it, with their sizes and its positions in
them, rare shingles first, in blocks that know their least and largest size and their least position. A set goes
through the lists of its prefix and skips blocks whose sizes are out of reach, and those whose positions leave
too little of their sets behind for the overlap that a link needs. The overlaps with what is met are
kept with the set. A set y that links to x derives its answers from those of x: its overlap with z is that of x
with z, plus the shingles of z that only y has and less those that only x has, which the lists
of these few shingles give; bounds decide most pairs without them. Only sets that x did not meet are compared anew,
and only sets that are not yet connected are looked for.

*Large components.* One of more than BLOCK elements is first cut anew, with another order of hashes, which
parts sets that met by chance, and again while that leaves far fewer sets in such components. If it is still as large it is spread: its members are
compared with a few pivots, each in the task where it lies; those that the largest star leaves over are compared, in chunks, with
all members, in blocks. No pair of different texts that could link is left out.

A null text or one without words has an empty set, n_shingles 0, and links with nothing; a null
id gets a null component_id and links with nothing. Rows that share an id are documents of their own, each
with the component of its text. Texts of any length are read whole; repeated rows are equal sets. Only the id
and the text are read, so other columns may have any names; an empty table gives an empty one. n_shingles
counts 64-bit hashes, and sets count as equal by 64 bits over all of these.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, shuffle_partitions, swept, table, tidy, written
from .components import connected
from .shingles import FACTORS, Hasher, U, exact, fingerprint, mix

WORDS, PERCENT = 4, 85
#: Elements of sets that one task compares with each other, and postings in a block of a list.
BLOCK, LIST_BLOCK = 1 << 15, 32
PIVOTS = 8
#: Times at most that candidate components of more than BLOCK elements are cut anew, before they are spread, and
#: the share of sets that may be left in them for another cut.
RECUTS, PARTED = 4, 0.75
#: One document of so many at least is looked at for common shingles, so that lists stay short in large tables.
SAMPLE_EVERY = 32
#: Ids that may be broadcast to fetch their texts; beyond, the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def most_differences(total: int, percent: int = PERCENT) -> int:
    """Elements in which linked sets can differ, given the sum of their sizes."""
    return total - 2 * -(-percent * total // (100 + percent))


def enough(overlap: np.ndarray, total: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * overlap >= percent * (total - overlap)


def size_classes(largest: int, percent: int = PERCENT) -> list[int]:
    """The largest size of each class, up to the class that holds `largest`. Partners of a set lie
    in its own class or in a next one."""
    ends = [1]
    while ends[-1] < largest:
        ends.append((ends[-1] + 1) * 100 // percent)
    return ends


def blocks_for(end: int, percent: int = PERCENT) -> tuple[int, int]:
    """(blocks, spare ones) for pairs whose smaller set has at most `end` elements. There are as
    many spare blocks as the smallest set of the class leaves empty, and four deviations more, or as it leaves with one element at most."""
    total = end + end * 100 // percent
    least = max(most_differences(t, percent) for t in range(max(2, total - 2 * (100 + percent)), total + 1)) + 1
    for spare in range(2, least + 3):
        mean = (percent / 100) * end / (least + spare)
        empty = (least + spare) * math.exp(-mean)
        if spare >= max(empty + 4 * math.sqrt(empty) + 2, empty * (1 + mean)):
            break
    return least + spare, spare


class Cuts:
    """(class, blocks, spare blocks) for the cuts that a set of n elements uses."""

    def __init__(self, percent: int = PERCENT) -> None:
        self.percent, self.ends, self.blocks = percent, [1], [blocks_for(1, percent)]

    def __call__(self, n: int) -> list[tuple[int, int, int]]:
        if self.ends[-1] < n:
            self.ends = size_classes(n, self.percent)
            self.blocks += [blocks_for(e, self.percent) for e in self.ends[len(self.blocks) :]]
        k = bisect.bisect_left(self.ends, n)
        return [(c, *self.blocks[c]) for c in (k, k - 1) if c >= 0]


def keys(s: np.ndarray, common: np.ndarray, cuts: Cuts, seed: int = 0) -> np.ndarray:
    """The index lists that a set enters; each seed cuts in another way."""
    usual = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
    if seed:
        s = mix(s ^ (U(seed) * FACTORS[2]))
        order = np.argsort(s)
        s, usual = s[order], usual[order]
    own = s[~usual]
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(own ^ FACTORS[3]), dtype=U)])
    out, crowded = [], False
    for k, blocks, spare in cuts(len(s)):
        edges = np.ceil(np.arange(blocks + 1) * (2.0**64 / blocks))
        at = np.searchsorted(own, edges[1:-1].astype(U))
        at = np.concatenate([[0], at, [len(own)]])
        held = np.diff(at)
        full = np.flatnonzero(held)
        crowded |= blocks - len(full) > spare
        content = sums[at[full + 1]] - sums[at[full]]
        found = mix(content + mix(full.astype(U) * FACTORS[0] + U(k + 1) * FACTORS[1]))
        out.append(found[np.lexsort((found, -held[full]))[: blocks - spare]])
    if crowded:
        prefix = np.concatenate([own, s[usual]])[: len(s) - -(-cuts.percent * len(s) // 100) + 1]
        out += [mix(prefix + U(k + 1) * FACTORS[2]) for k, _, _ in cuts(len(s))]
    return np.concatenate(out)


# -- the index --------------------------------------------------------------------------------


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, n, node) of (id, text): the size of its set and what stands for it, null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Hasher(words)
        for batch in batches:
            got = [(len(s), fingerprint(s) if len(s) else None) for s in make(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], ["id", "n", "node"])

    return docs.mapInArrow(tidy(run), "id long, n long, node long")


BLOBS = "bucket int, keys binary, nodes binary, a binary, b binary"


def blobs(buckets: int, ks: np.ndarray, nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Sorted keys with their nodes, and edges, as one row for each bucket of keys."""
    shift = 64 - (buckets.bit_length() - 1)
    of = (lambda x: (x >> U(shift)).astype(np.int64)) if shift < 64 else (lambda x: np.zeros(len(x), np.int64))
    at = np.searchsorted(of(ks), np.arange(buckets + 1))
    home = of(mix(a.view(U)))
    order = np.argsort(home, kind="stable")
    a, b, to = a[order], b[order], np.searchsorted(home[order], np.arange(buckets + 1))
    used = np.flatnonzero((np.diff(at) > 0) | (np.diff(to) > 0))
    piece = lambda x, w: pa.array([x[w[i] : w[i + 1]].tobytes() for i in used], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), piece(ks, at), piece(nodes, at), piece(a, to), piece(b, to)], ["bucket", "keys", "nodes", "a", "b"])


def chained(ks: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, smallest node of each) and the distinct edges from the others to it."""
    order = np.lexsort((nodes, ks))
    ks, nodes = ks[order], nodes[order]
    new = np.concatenate([[True], ks[1:] != ks[:-1]]) if len(ks) else np.zeros(0, bool)
    head = nodes[new][np.cumsum(new) - 1]
    other = nodes != head
    edges = np.unique(np.stack([nodes[other], head[other]]), axis=1) if other.any() else np.zeros((2, 0), np.int64)
    return ks[new], nodes[new], edges[0], edges[1]


def candidate_edges(docs: DataFrame, common: np.ndarray, buckets: int, seed: int = 0, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b) of sets: chains of the members of every index list. With a column comp, lists hold
    members of one component only."""
    apart = "comp" in docs.columns

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, cuts = Hasher(words), Cuts(percent)
        for batch in batches:
            seen, ks, nodes = set(), [], []
            comps = mix(batch.column("comp").to_numpy().view(U)) if apart else None
            for i, s in enumerate(make(batch.column("text"))):
                if len(s) and (node := fingerprint(s)) not in seen:
                    seen.add(node)
                    with np.errstate(over="ignore"):
                        k = keys(s, common, cuts, seed)
                    ks.append(mix(k ^ comps[i]) if apart else k)
                    nodes.append(np.full(len(k), node, np.int64))
            if ks:
                yield blobs(buckets, *chained(np.concatenate(ks), np.concatenate(nodes)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for rows in grouped(batches, ["bucket"]):
            join = lambda name, kind: np.frombuffer(b"".join(rows[name]), kind)
            _, _, a, b = chained(join("keys", U), join("nodes", np.int64))
            found.append(np.stack([np.concatenate([a, join("a", np.int64)]), np.concatenate([b, join("b", np.int64)])]))
        if found:
            e = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], ["a", "b"])

    sent = docs.mapInArrow(tidy(index), BLOBS).repartition(shuffle_partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(tidy(merge), "a long, b long").distinct()


def grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[dict[str, list]]:
    """Rows that stand together and agree on `by`, as lists by column."""
    held: dict[str, list] | None = None
    key = None
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        ids = list(zip(*(cols[n] for n in by), strict=True))
        at = 0
        while at < len(ids):
            to = at + 1
            while to < len(ids) and ids[to] == ids[at]:
                to += 1
            if held is not None and ids[at] == key:
                for n, v in cols.items():
                    held[n] += v[at:to]
            else:
                if held is not None:
                    yield held
                held, key = {n: v[at:to] for n, v in cols.items()}, ids[at]
            at = to
    if held is not None:
        yield held


def common_shingles(docs: DataFrame, sample: int, least: int, most: int = 1 << 17, words: int = WORDS) -> np.ndarray:
    """Shingles of at least `least` of about `sample` documents, or of one of SAMPLE_EVERY if that is more, the `most` commonest, sorted."""
    every = max(1, min(SAMPLE_EVERY, -(-docs.count() // sample)))
    some = docs.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(every)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Hasher(words)
        for batch in batches:
            if sets := [s for s in make(batch.column("text")) if len(s)]:
                k, n = np.unique(np.concatenate(sets), return_counts=True)
                none = np.zeros(0, np.int64)
                yield blobs(64, k, n.astype(np.int64), none, none)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["bucket"]):
            k, at = np.unique(np.frombuffer(b"".join(rows["keys"]), U), return_inverse=True)
            n = np.bincount(at, np.frombuffer(b"".join(rows["nodes"]), np.int64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k[n >= least].view(np.int64)), pa.array(n[n >= least])], ["k", "n"])

    found = some.mapInArrow(count, BLOBS).repartition(min(64, shuffle_partitions(docs.sparkSession)), "bucket").sortWithinPartitions("bucket").mapInArrow(total, "k long, n long")
    return np.sort(np.array([r[0] for r in found.orderBy(F.desc("n"), "k").limit(most).select("k").collect()], np.int64).view(U))


# -- verification -----------------------------------------------------------------------------


class Lists:
    """Index lists of a few sets, in blocks of sizes and positions. sets: sorted numbers of shingles."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.m, self.percent = len(sets), percent
        self.sizes = np.array([len(s) for s in sets])
        names, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(names))  # rare ones first
        owner = np.repeat(np.arange(self.m), self.sizes)
        order = np.lexsort((rank[ids.reshape(-1)], owner))
        self.ids = rank[ids.reshape(-1)][order]  # the elements of each set in that order
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        position = np.arange(len(self.ids)) - np.repeat(self.starts[:-1], self.sizes)
        order = np.lexsort((position, self.sizes[owner], self.ids))
        self.owner, self.position = owner[order], position[order]
        listed = self.ids[order]
        self.first = np.searchsorted(listed, np.arange(len(names) + 1))
        at = np.arange(len(listed)) - self.first[listed]
        self.block = np.flatnonzero(at % LIST_BLOCK == 0)  # where blocks begin
        self.block_end = np.append(self.block[1:], len(listed))
        self.block_of = np.searchsorted(self.block, self.first)  # each list's first block
        self.least = self.sizes[self.owner[self.block]]
        self.most = self.sizes[self.owner[self.block_end - 1]]
        self.front = np.minimum.reduceat(self.position, self.block) if len(self.block) else self.block

    def of(self, x: int) -> np.ndarray:
        return self.ids[self.starts[x] : self.starts[x + 1]]

    def needed(self, n: int, sizes: np.ndarray) -> np.ndarray:
        """The overlap that a link between a set of n elements and one of some size takes."""
        return -(-self.percent * (n + sizes) // (100 + self.percent))

    @staticmethod
    def spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All numbers from starts to ends, and which range each is of."""
        n = end - start
        which = np.repeat(np.arange(len(n)), n)
        return start[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), which

    def met(self, x: int, left: np.ndarray) -> np.ndarray:
        """Sets of `left` that could link to x, by the blocks of the lists of its prefix."""
        n = self.sizes[x]
        low, high = -(-self.percent * n // 100), 100 * n // self.percent
        prefix = self.of(x)[: n - int(self.needed(n, np.array(low))) + 1]
        blocks, i = self.spread(self.block_of[prefix], self.block_of[prefix + 1])
        close = (self.most[blocks] >= low) & (self.least[blocks] <= high)
        # a first common element at place i of x and j of y leaves 1 + min(n - i, size - j) - 1 at most
        close &= self.most[blocks] - self.front[blocks] >= self.needed(n, np.maximum(self.least[blocks], low))
        blocks, i = blocks[close], i[close]
        postings, which = self.spread(self.block[blocks], self.block_end[blocks])
        y, j, i = self.owner[postings], self.position[postings], i[which]
        fits = left[y] & (np.minimum(n - i, self.sizes[y] - j) >= self.needed(n, self.sizes[y]))
        return np.unique(y[fits])

    def overlaps(self, x: int, others: np.ndarray) -> np.ndarray:
        """Counted in the other sets themselves."""
        if not len(others):
            return np.zeros(0, np.int64)
        mine = np.zeros(len(self.first) - 1, bool)
        mine[self.of(x)] = True
        at, which = self.spread(self.starts[others], self.starts[others + 1])
        return np.bincount(which, mine[self.ids[at]], minlength=len(others)).astype(np.int64)

    def held(self, elements: np.ndarray) -> np.ndarray:
        """How many of the elements each set has, from their lists."""
        at, _ = self.spread(self.first[elements], self.first[elements + 1])
        return np.bincount(self.owner[at], minlength=self.m)

    def apart(self, y: int, x: int) -> tuple[np.ndarray, np.ndarray]:
        """What y has and x lacks, and the other way round."""
        a, b = self.of(y), self.of(x)
        return np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)


def search(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each set, the first one that it is connected to by links."""
    lists = Lists(sets, percent)
    root, left = np.arange(lists.m), np.ones(lists.m, bool)
    for seed in range(lists.m):
        if not left[seed]:
            continue
        left[seed] = False
        #: A set, the one it was linked from, and what that one met, with exact overlaps.
        queue: list[tuple[int, int, np.ndarray, np.ndarray]] = [(seed, seed, np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while queue and left.any():
            y, x, known, overlap = queue.pop()
            still = left[known]
            known, overlap = known[still], overlap[still]
            gained, lost = lists.apart(y, x)
            needed = lists.needed(lists.sizes[y], lists.sizes[known])
            linked = overlap - len(lost) >= needed  # what the bounds decide
            if (~linked & (overlap + len(gained) >= needed)).any():
                overlap = overlap + (lists.held(gained) - lists.held(lost))[known]
                linked, gained = overlap >= needed, None
            new = np.setdiff1d(lists.met(y, left), known, assume_unique=True)
            fresh = lists.overlaps(y, new)
            answers = np.concatenate([known[linked], new[fresh >= lists.needed(lists.sizes[y], lists.sizes[new])]])
            left[answers], root[answers] = False, seed
            rest = left[known]
            if len(answers) and rest.any() and gained is not None:  # exact before they are passed on
                overlap = overlap + (lists.held(gained) - lists.held(lost))[known]
            stay = left[new]
            kept, counted = np.concatenate([known[rest], new[stay]]), np.concatenate([overlap[rest], fresh[stay]])
            queue += [(int(z), y, kept, counted) for z in answers]
    return root


def overlap_of(a: str, b: str, words: int) -> tuple[int, int]:
    """(overlap, sum of sizes) of two texts' sets, by their words."""
    x, y = exact([a, b], words)
    return np.intersect1d(x, y, assume_unique=True).size, len(x) + len(y)


def resolved(members: DataFrame, by: list[str], words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b): every set and one that it is connected to, in each group of rows (by..., node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, by):
            texts = dict(zip(rows["node"], rows["text"], strict=True))
            nodes = np.array(sorted(texts), np.int64)
            root = search(exact([texts[n] for n in nodes.tolist()], words), percent)
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])

    spread = members.repartition(shuffle_partitions(members.sparkSession), *by).sortWithinPartitions(*by)
    return spread.mapInArrow(tidy(run), "a long, b long")


def checked(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, text) without rows whose text has another set, as rows that share an id may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Hasher(words)
        for batch in batches:
            want = batch.column("node").to_pylist()
            ok = [i for i, s in enumerate(make(batch.column("text"))) if len(s) and fingerprint(s) == want[i]]
            yield batch.take(pa.array(ok, pa.int64()))

    return texts.mapInArrow(tidy(run), "node long, text string")


def large_links(members: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b) for candidate components too large for one task; members: (comp, node, n, text)."""
    ranked = members.select("comp", F.struct(F.xxhash64("node", F.lit(5)).alias("h"), "node").alias("x"))
    of_all = F.pmod(F.col("x.h"), F.lit(16 * PIVOTS)) == 0
    some = ranked.filter(of_all).withColumn("n", F.row_number().over(Window.partitionBy("comp").orderBy("x"))).filter(F.col("n") <= PIVOTS).select("comp", "x")
    chosen = some.unionByName(ranked.groupBy("comp").agg(F.min("x").alias("x"))).select("comp", F.col("x.node").alias("node")).distinct()
    pivots = members.select("node", "text").join(written(chosen, "jaccard-pivots"), "node").groupBy("comp").agg(F.collect_list("node").alias("pivots"), F.collect_list("text").alias("texts"))  # at most PIVOTS + 1

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, known = Hasher(words), {}
        for batch in batches:
            a, b = [], []
            comps, nodes, pivots, texts, own = (batch.column(c) for c in ("comp", "node", "pivots", "texts", "text"))
            for i, x in enumerate(make(own)):
                comp, node = comps[i].as_py(), nodes[i].as_py()
                if comp not in known:
                    theirs = texts[i].as_py()
                    known = {comp: list(zip(pivots[i].as_py(), make(pa.array(theirs, pa.string())), theirs, strict=True))}
                for pivot, y, its in known[comp]:
                    if node != pivot and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and enough(np.intersect1d(x, y, assume_unique=True).size, len(x) + len(y), percent) and enough(*overlap_of(own[i].as_py(), its, words), percent):
                        a.append(node)
                        b.append(pivot)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = written(members.join(pivots, "comp").mapInArrow(stars, "a long, b long"), "jaccard-stars")
    roots = connected(links, "jaccard-star-components") if not links.isEmpty() else None
    placed = members.join(roots, "node", "left") if roots else members.withColumn("root", F.lit(None).cast("long"))
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    sizes = written(placed.groupBy("comp", "root").agg(F.sum("n").alias("size")), "jaccard-star-sizes")
    main = sizes.groupBy("comp").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.sum("size").alias("total"), (F.sum("size") - F.max("size")).alias("rest"))
    lots = main.filter("rest > 0").select("comp", "main", F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("rest") / BLOCK).cast("int").alias("chunks"))
    rows = placed.join(lots, "comp")
    lot = lambda k, n: F.pmod(F.xxhash64("node", F.lit(k)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = rows.select("comp", lot(17, "blocks").alias("block"), each("chunks").alias("chunk"), "node", "text")
    chunk = rows.filter("root <> main").select("comp", each("blocks").alias("block"), lot(19, "chunks").alias("chunk"), "node", "text")
    return links.unionByName(resolved(block.unionByName(chunk), ["comp", "block", "chunk"], words, percent))


def links_of(docs: DataFrame, firsts: DataFrame, edges: DataFrame, common: np.ndarray, block: int, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b) of sets, enough links for the components, from the candidate edges."""
    sized = lambda found: found.join(firsts, "node").select("node", "n", F.col("first").alias("id"), F.col("root").alias("comp"))
    comps = written(sized(connected(edges, "jaccard-candidates")), "jaccard-comps-0")
    small = comps.count() <= BROADCAST_IDS  # with another way beyond
    near = lambda df, other, on: df.join(F.broadcast(other) if small else other, on)
    members = written(checked(near(docs, comps.select("id", "node"), "id").select("node", "text"), words), "jaccard-members", compression="zstd")
    swept(docs.sparkSession)
    sizes = lambda: comps.groupBy("comp").agg(F.sum("n").alias("size"))
    before = math.inf
    for seed in range(1, 1 + RECUTS):
        large = sizes().filter(F.col("size") > block).select("comp")
        inside = comps.join(large, "comp", "left_semi")
        held = inside.agg(F.count(F.lit(1)), F.countDistinct("comp")).first()
        if not held[0] or held[0] > PARTED * before:
            break
        before = held[0]
        # chance may have brought them together: cut in another way, linked sets meet again
        inside = written(inside, f"jaccard-large-{seed}")
        again = written(candidate_edges(near(members, inside.select("node", "comp"), "node"), common, 1 << max(6, (held[0] // 1000).bit_length()), seed, words, percent), f"jaccard-edges-{seed}")
        outside = comps.join(large, "comp", "left_anti").select(*comps.columns)
        comps = written(outside if again.isEmpty() else outside.unionByName(sized(connected(again, f"jaccard-candidates-{seed}")).select(*comps.columns)), f"jaccard-comps-{seed}")
    sized_comps = written(comps.join(sizes(), "comp"), "jaccard-sized")
    fit = near(members, sized_comps.filter(F.col("size") <= block).select("node", "comp"), "node")
    links = resolved(fit, ["comp"], words, percent)
    beyond = sized_comps.filter(F.col("size") > block).select("node", "comp", "n")
    if not beyond.isEmpty():
        links = links.unionByName(large_links(near(members, beyond, "node"), words, percent))
    return links


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 8_000, least: int = 6, block: int = BLOCK, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, set_id), one row for each row of docs; equal set_id: equal sets."""
    with scratch(docs.sparkSession):
        docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        sets = written(sets_of(docs, words), "jaccard-sets")
        live = docs.filter("id IS NOT NULL AND text IS NOT NULL")
        common = common_shingles(live, sample, least, words=words)
        buckets = 1 << max(6, (sets.count() // 1000).bit_length())
        edges = written(candidate_edges(live, common, buckets, words=words, percent=percent), "jaccard-edges")
        swept(docs.sparkSession)
        firsts = sets.filter("node IS NOT NULL AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("first"), F.min("n").alias("n"))
        if edges.isEmpty():
            names = firsts.select("node", F.col("first").alias("component_id"))
        else:
            links = written(links_of(live, firsts, edges, common, block, words, percent), "jaccard-links")
            roots = connected(links, "jaccard-components") if not links.isEmpty() else None
            rooted = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")) if roots else firsts.withColumn("root", F.col("node"))
            names = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
        out = sets.join(names, "node", "left")
        return written(out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"), F.col("node").alias("set_id")), "jaccard-answers", keep=True)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with docs' own columns."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}  # so that no name of docs is in the way
    mine = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    me, text = F.col(names[id_col]).cast("long"), names[text_col]
    found = written(jaccard_components(docs, id_col=id_col, text_col=text_col, words=words, percent=percent), "jaccard-result")
    goes = F.coalesce(F.col("component_id") != F.col("id"), F.lit(False))
    by_id = written(found.groupBy("id").agg(F.max(goes).alias("some"), F.min(goes).alias("every")).filter("some"), "jaccard-dropped")
    few = by_id.count() <= BROADCAST_IDS
    near = lambda df: F.broadcast(df) if few else df
    left = mine.join(near(by_id.select(F.col("id").alias("gone"))), me == F.col("gone"), "left_anti")
    mixed = by_id.filter(~F.col("every")).select(F.col("id").alias("gone"))
    if not mixed.isEmpty():  # ids of several rows, some of which go: these are told apart by their sets

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make = Hasher(words)
            for batch in batches:
                nodes = [fingerprint(x) if len(x) else 0 for x in make(batch.column(text))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], [*batch.schema.names, "node"])

        some = mine.join(near(mixed), me == F.col("gone"), "left_semi")
        some = some.mapInArrow(tidy(marked), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema), "node long"]))
        dropped = found.filter(goes).select(F.col("id").alias("gone"), F.col("set_id").alias("gone_set")).distinct()
        left = left.unionByName(some.join(dropped, (me == F.col("gone")) & (F.col("node") == F.col("gone_set")), "left_anti").drop("node"))
    return left.select(*(F.col(n).alias(c) for c, n in names.items()))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT y AS doc_id, x AS root FROM l UNION SELECT e.y, root FROM r JOIN e ON e.x = r.doc_id WHERE root < e.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) USING (doc_id)
"""
