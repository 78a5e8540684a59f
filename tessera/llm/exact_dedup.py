"""Exact deduplication by an extendible-hash index kept in shared files.

Texts are equal when they are the same bytes after the six ASCII white-space characters are
deleted. A 64-bit hash of those bytes is a text's key. All steps are DataFrame operations:

1. *Probes.* One pass over the documents writes a narrow table: id, length, key, SHA-256, size.
2. *Directory.* It starts as one bucket, the whole range of keys. A bucket whose different keys hold more
   than ``capacity`` bytes is split on its next bit; if it was as deep as the directory, the directory
   doubles. Splits go on, to the last bit, until no bucket with more than one key is overfull. Keys are
   counted for a few more bits at a time, and then only those in overfull buckets. The capacity is lowered while
   there are fewer buckets than owners could work on, and grows with the
   input beyond ``buckets`` buckets, which bounds the directory that is broadcast.
3. *Owners.* Texts go to the owner of their key's bucket, by a look into the directory. An owner sorts
   its range of keys, compares the bytes of texts with equal keys, makes one entry of those that are the
   same and chains those that collide on a key. Copies of a key that has very many are combined in
   the map tasks first, in lots. Entries hold key, chain, bytes, SHA-256, group size and the row that stays;
   owners write them to the shared folder.
4. *Look-ups.* Every probe finds its bucket in the directory and its entry there, by key and SHA-256: an
   equi-join of narrow rows, which adaptive execution splits where one text holds a large part of all rows.

Nulls count as empty texts; empty texts are equal to each other. A null id takes part in its
group and is kept only if the group has no other id. Rows repeated whole (same id, same text)
count as many in group_size and share one ``kept``; ``drop_copies`` leaves one of them. An empty table
gives an empty one. Texts may be of any length that a row can hold.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, shuffle_partitions, table, written

#: The characters deleted before comparison: space, and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Four times the largest id: rows of different length never meet in length * STEP - id.
STEP = "36893488147419103232"
#: Bytes that an entry takes besides its text.
ENTRY = 100
#: Bytes below which no bucket is split for the sake of more owners.
LEAST_CAPACITY = 1 << 16
#: Rows to drop that may be broadcast.
BROADCAST_ROWS = 1_000_000


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for x in SPACES:
        out = F.replace(out, F.lit(x), F.lit(""))
    return out


def key_of(norm: Column, bits: int = 64) -> Column:
    h = F.xxhash64(norm)
    return h if bits == 64 else F.shiftleft(h, 64 - bits)


def top_bits(key: Column, n: int) -> Column:
    return F.shiftrightunsigned(key, 64 - n) if n else F.lit(0).cast("long")


@dataclass(frozen=True)
class Bucket:
    prefix: int
    depth: int
    load: int
    keys: int


@dataclass
class Directory:
    """Buckets of an extendible-hash index; depth: bits of a key that a look-up may need."""

    capacity: int
    depth: int = 0
    buckets: list[Bucket] = field(default_factory=list)
    #: Bits of the pages by which a look-up finds the few buckets that may hold a key.
    PAGE = 12

    def overfull(self, b: Bucket) -> bool:
        return b.load > self.capacity and b.keys > 1 and b.depth < 64

    def insert(self, start: Bucket, counts: dict[int, tuple[int, int]], bits: int) -> list[Bucket]:
        """Splits a bucket by the loads and keys counted for prefixes of `bits` bits; what is overfull yet."""
        left, todo = [], [start]
        while todo:
            b = todo.pop()
            if not self.overfull(b):
                self.buckets.append(b)
            elif b.depth == bits:
                left.append(b)
            else:
                self.depth = max(self.depth, b.depth + 1)  # the directory doubles
                width = bits - b.depth - 1
                halves: dict[int, list[int]] = {2 * b.prefix: [0, 0], 2 * b.prefix + 1: [0, 0]}
                inside = {p: c for p, c in counts.items() if p >> (width + 1) == b.prefix} if b.depth else counts
                for p, (load, keys) in inside.items():
                    halves[p >> width][0] += load
                    halves[p >> width][1] += keys
                todo += [Bucket(p, b.depth + 1, *x) for p, x in halves.items()]
        return left

    def bucket_of(self, df: DataFrame, key: str = "key") -> DataFrame:
        """df with a column bucket. The directory's pages are broadcast: they are as many as its buckets."""
        page = min(self.PAGE, self.depth)
        pages: dict[int, list[tuple[int, int, int]]] = {}
        for i, b in enumerate(sorted(self.buckets, key=lambda b: b.prefix << (64 - b.depth))):
            low = b.prefix << (page - b.depth) if b.depth <= page else b.prefix >> (b.depth - page)
            for p in range(low, low + (1 << max(0, page - b.depth))):
                pages.setdefault(p, []).append((b.depth, b.prefix, i))
        held = df.sparkSession.createDataFrame([(p, x) for p, x in pages.items()], "__page long, __buckets array<struct<depth:int,prefix:long,bucket:int>>")
        found = df.withColumn("__page", top_bits(F.col(key), page)).join(F.broadcast(held), "__page")
        mine = F.filter("__buckets", lambda b: F.when(b["depth"] == 0, True).otherwise(F.call_function("shiftrightunsigned", F.col(key), 64 - b["depth"]) == b["prefix"]))
        return found.withColumn("bucket", mine[0]["bucket"]).drop("__page", "__buckets")


def grow(keys: DataFrame, capacity: int, buckets: int, step: int = 8) -> Directory:
    """The directory for (key, size), one row for each different key."""
    total, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    # enough buckets to keep all owners busy, not more than the directory may have
    busy = max(LEAST_CAPACITY, total // (8 * shuffle_partitions(keys.sparkSession)))
    made = Directory(max(min(capacity, busy), total // buckets))
    signed = lambda p, bits: p - (1 << 64) if bits == 64 and p >= 1 << 63 else p
    bits, open_buckets, rows = 0, [Bucket(0, 0, total, n)], keys
    open_buckets = made.insert(open_buckets[0], {}, 0)
    while open_buckets:
        deeper = min(64, bits + step)
        if bits:  # only keys in overfull buckets are counted again; these are at most as many as buckets
            held = keys.sparkSession.createDataFrame([(signed(b.prefix, bits),) for b in open_buckets], "__p long")
            rows = keys.join(F.broadcast(held), top_bits(F.col("key"), bits) == F.col("__p"), "left_semi")
        counts = {r[0] % (1 << 64): (r[1], r[2]) for r in rows.groupBy(top_bits(F.col("key"), deeper).alias("p")).agg(F.sum("size"), F.count(F.lit(1))).collect()}
        apart: dict[int, dict[int, tuple[int, int]]] = {}
        for p, c in counts.items():
            apart.setdefault(p >> (deeper - bits), {})[p] = c
        open_buckets = [x for b in open_buckets for x in made.insert(b, apart.get(b.prefix, {}), deeper)]
        bits = deeper
    return made


def rank_of(n: Column, id_: Column) -> Column:
    """Greater for longer texts, then for smaller ids; null for a null id."""
    order = (n.cast("decimal(38,0)") * F.lit(STEP).cast("decimal(20,0)")).cast("decimal(38,0)")
    return (order - id_.cast("decimal(20,0)")).cast("decimal(38,0)")


def build_index(docs: DataFrame, probes: DataFrame, directory: Directory, id_col: str, text_col: str, bits: int, hot_rows: int) -> DataFrame:
    """Entries (bucket, key, chain, norm, sha, group_size, keep_id, keep_length), written by the owners of buckets."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    arrivals = docs.select(normalised(F.col(text_col)).alias("norm"), F.lit(1).cast("long").alias("copies"), rank_of(F.char_length(text), F.col(id_col).cast("long")).alias("best"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(64)).cast("int").alias("lot")).withColumn("key", key_of(F.col("norm"), bits))
    hot = [r[0] for r in probes.groupBy("key").count().filter(F.col("count") > hot_rows).select("key").collect()]  # at most rows / hot_rows
    each = arrivals.drop("lot")
    if hot:
        held = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in hot], "key long"))
        combined = arrivals.join(held, "key", "left_semi").groupBy("lot", "key", "norm").agg(F.sum("copies").alias("copies"), F.max("best").alias("best")).drop("lot")
        each = each.join(held, "key", "left_anti").unionByName(combined)
    # one owner for a bucket: what follows needs no other exchange
    owned = directory.bucket_of(each).repartition(shuffle_partitions(docs.sparkSession), "bucket")
    same = owned.groupBy("bucket", "key", "norm").agg(F.sum("copies").alias("group_size"), F.max("best").alias("best"))
    chained = same.withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "key").orderBy("norm")))
    step = F.lit(STEP).cast("decimal(20,0)")
    length = F.round(F.col("best") / step, 0).cast("long")
    keep = (length.cast("decimal(20,0)").cast("decimal(38,0)") * step).cast("decimal(38,0)") - F.col("best")
    return written(chained.select("bucket", "key", "chain", "norm", F.sha2("norm", 256).alias("sha"), "group_size", keep.cast("long").alias("keep_id"), length.alias("keep_length")), "dedup-index")


def looked_up(docs: DataFrame, id_col: str, text_col: str, capacity: int, buckets: int, hash_bits: int, hot_rows: int) -> DataFrame:
    """(id, n, sha, keep_id, group_size, kept, chain) for every row of docs."""
    with scratch(docs.sparkSession):
        norm = normalised(F.col(text_col))
        probes = written(docs.select(F.col(id_col).cast("long").alias("id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"), key_of(norm, hash_bits).alias("key"), F.sha2(norm, 256).alias("sha"), F.octet_length(norm).alias("size")), "dedup-probes")
        keys = written(probes.groupBy("key").agg(F.max("size").cast("long").alias("size")), "dedup-keys")
        directory = grow(keys.withColumn("size", F.col("size") + ENTRY), capacity, buckets)
        index = build_index(docs, probes, directory, id_col, text_col, hash_bits, max(hot_rows, probes.count() // 10_000))
        found = directory.bucket_of(probes).join(index.drop("norm"), ["bucket", "key", "sha"])
        kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("keep_id").isNull() | (F.col("n") == F.col("keep_length")))
        return written(found.select("id", "n", "sha", "keep_id", "group_size", kept.alias("kept"), "chain"), "dedup-answers", keep=True)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 1 << 24, buckets: int = 1 << 16, hash_bits: int = 64, hot_rows: int = 1_000) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256, chain), one row for each row of docs; chain 1: no collision.

    No other column of docs is read, so they may have any names. capacity: bytes in a bucket; hash_bits
    under 64 shortens the key so that tests can force collisions."""
    found = looked_up(docs, id_col, text_col, capacity, buckets, hash_bits, hot_rows)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"), "chain")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 1 << 24, buckets: int = 1 << 16, hash_bits: int = 64, hot_rows: int = 1_000) -> DataFrame:
    """The rows of docs that stay, one for each different text, with their own columns. Texts do not
    move while the rows to drop are few enough to be broadcast; beyond, they are joined by a shuffle."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}  # so that no name of docs is in the way
    mine = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    me, text = names[id_col], names[text_col]
    found = looked_up(mine, me, text, capacity, buckets, hash_bits, hot_rows)
    gone = found.filter(~F.col("kept")).select(F.col("id").alias("gone_id"), F.col("sha").alias("gone_sha")).distinct()
    # rows repeated whole: only where a group keeps more than one row
    twice = found.filter(F.col("kept") & (F.col("group_size") > 1)).groupBy("sha").count().filter(F.col("count") > 1).select(F.col("sha").alias("twice_sha"))
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    rows = mine.withColumn("__sha", F.sha2(normalised(F.col(text)), 256))
    left = rows.join(few(gone), F.col(me).cast("long").eqNullSafe(F.col("gone_id")) & (F.col("__sha") == F.col("gone_sha")), "left_anti")
    if not twice.isEmpty():
        held = few(twice)
        once = left.join(held, F.col("__sha") == F.col("twice_sha"), "left_semi").dropDuplicates(["__sha"])
        left = left.join(held, F.col("__sha") == F.col("twice_sha"), "left_anti").unionByName(once)
    return left.select(*(F.col(n).alias(c) for c, n in names.items()))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", F.col("chain").alias("chain_position"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256, 1::INTEGER AS chain_position FROM g
"""
