"""Byte-level BPE encoding and decoding by recursive queries in an embedded DuckDB per partition.

A text is cut by the tokenizer's pattern. Words that are not yet known to the task go to DuckDB as
rows (piece, position, id of a byte). A recursive query joins neighbouring positions with the merge
table and contracts, in every piece at once, the leftmost pair of the smallest rank, until no piece
has a pair left. In order of positions these are the words' ids; an ordered aggregation of their
tokens, looked up in the vocabulary, decodes them. A text's ids and decoded bytes are its words' in order.

*Pieces.* No token holds two neighbouring bytes that no token of the vocabulary holds, so a word is
cut there and its pieces contract on their own; nearly all are a few bytes, also those of long words.

*State.* A round passes on the pieces that still have a pair; a piece without one leaves, marked
done, and only such rows are kept, so memory is that of one state, whatever the number of rounds. In
pieces of more than LONG bytes (repeated signs, mostly) a round contracts every leftmost pair of the
smallest rank in a row, up to the first that makes a pair of a smaller rank: what single steps
would do, in rounds that grow with the different ranks and not with the length.

The merge table has every pair of tokens whose bytes together are a token, with its rank. A word that
is a token stands for itself, as the tiktoken library has it.

Vocabulary and merges are broadcast: they are as large as the vocabulary file, not as the data. A
task works on about GROUP characters of text at a time, hands DuckDB words of CHUNK bytes at a time,
long pieces LONG_CHUNK bytes at a time (a longer one alone), and forgets its words beyond CACHE, so its memory does not grow with a
partition; one text at a time is held whole. DuckDB has no folder to spill to. A null text counts as
empty: no ids, no bytes. Rows are independent, so repeated rows get equal answers; an empty table
gives an empty one. Columns of docs are passed on, and their own columns named ids or decoded are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

GROUP, CACHE, LONG, CHUNK, LONG_CHUNK = 1_500_000, 250_000, 512, 1_000_000, 200_000

#: State: a row for each token of a piece, with its position and the next token's position and id.
CONTRACT = """
WITH RECURSIVE bpe(done, piece, pos, id, next_pos, next_id) AS (
  SELECT false, piece, pos, id, next_pos, next_id FROM parts
  UNION ALL
  (WITH ranked AS (
     SELECT b.piece, b.next_pos, m.rank::BIGINT * 4294967296 + b.pos AS place FROM bpe b JOIN merges m ON b.id = m.a AND b.next_id = m.b WHERE NOT b.done
   ), best AS (
     SELECT piece, min(place) AS place, arg_min(next_pos, place) AS gone FROM ranked GROUP BY piece
   ), cut AS (
     SELECT best.piece, (place % 4294967296)::INTEGER AS spot, (place // 4294967296)::INTEGER AS made, gone, g.next_pos AS new_pos, g.next_id AS new_id
     FROM best JOIN bpe g ON g.pos = best.gone
   )
   SELECT cut.piece IS NULL, b.piece, b.pos,
     CASE WHEN b.pos = spot THEN made ELSE b.id END,
     CASE WHEN b.pos = spot THEN new_pos ELSE b.next_pos END,
     CASE WHEN b.pos = spot THEN new_id WHEN b.next_pos = spot THEN made ELSE b.next_id END
   FROM bpe b LEFT JOIN cut ON b.piece = cut.piece WHERE NOT b.done AND b.pos IS DISTINCT FROM gone)
)
SELECT pos, id FROM bpe WHERE done
"""
#: The same for long pieces. taken: of pairs that overlap, every other one; early: the first pair whose
#: contraction makes a pair of a smaller rank, with which the round ends.
CONTRACT_LONG = """
WITH RECURSIVE bpe(done, piece, pos, id) AS (
  SELECT false, piece, pos, id FROM parts
  UNION ALL
  (WITH near AS (
     SELECT piece, pos, id, lag(id) OVER w AS id0, lead(id) OVER w AS id1, lead(id, 2) OVER w AS id2, row_number() OVER w AS i
     FROM bpe WHERE NOT done WINDOW w AS (PARTITION BY piece ORDER BY pos)
   ), ranked AS (
     SELECT near.*, m.rank FROM near LEFT JOIN merges m ON near.id = m.a AND near.id1 = m.b
   ), least AS (
     SELECT piece, min(rank) AS made FROM ranked GROUP BY piece
   ), hits AS (
     SELECT r.*, made, coalesce(rank = made, false) AS hit,
       i - coalesce(max(CASE WHEN rank = made THEN NULL ELSE i END) OVER (PARTITION BY r.piece ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS run
     FROM ranked r JOIN least ON r.piece = least.piece
   ), taken AS (
     SELECT *, hit AND run % 2 = 1 AS take FROM hits
   ), beside AS (
     SELECT *, coalesce(lag(take) OVER w, false) AS gone, CASE WHEN lag(take, 2) OVER w THEN made ELSE id0 END AS left_id
     FROM taken WINDOW w AS (PARTITION BY piece ORDER BY i)
   ), early AS (
     SELECT t.piece, min(t.i) AS stop FROM beside t
     LEFT JOIN merges l ON l.a = t.left_id AND l.b = t.made LEFT JOIN merges r ON r.a = t.made AND r.b = t.id2
     WHERE t.take AND (l.rank < t.made OR r.rank < t.made) GROUP BY t.piece
   )
   SELECT made IS NULL, b.piece, b.pos, CASE WHEN take AND b.i <= coalesce(stop, b.i) THEN made ELSE id END
   FROM beside b LEFT JOIN early ON b.piece = early.piece WHERE NOT (gone AND b.i - 1 <= coalesce(stop, b.i)))
)
SELECT pos, id FROM bpe WHERE done
"""
DECODED = "SELECT string_agg(hex, '' ORDER BY pos) AS decoded FROM contracted JOIN vocabulary USING (id)"


def ranks_of(path: str) -> dict[bytes, int]:
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


def merges_of(ranks: dict[bytes, int]) -> np.ndarray:
    """Columns (a, b, rank): tokens a and b make the token of that rank."""
    found = [(a, b, k) for token, k in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
    return np.array(found, np.int32).reshape(-1, 3).T


class Encoder:
    """Words to ids and back, with a DuckDB of its own."""

    def __init__(self, ranks: dict[bytes, int], merges: np.ndarray, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.tokens = {k: t for t, k in ranks.items()}
        self.sizes = np.zeros(max(self.tokens, default=0) + 1, np.int64)
        self.sizes[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.touch = np.zeros((256, 256), bool)  # bytes that stand together in some token
        for t in ranks:
            b = np.frombuffer(t, np.uint8)
            self.touch[b[:-1], b[1:]] = True
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.decoded: dict[str, bytes] = {}  # and what they decode to
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        for name, cols in (("merges", dict(zip(("a", "b", "rank"), merges, strict=True))), ("vocabulary", {"id": np.array(list(self.tokens), np.int32), "hex": [t.hex() for t in self.tokens.values()]})):
            self.db.register("given", pa.table(cols))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def learn(self, words: Iterable[str]) -> None:
        todo: list[tuple[str, bytes]] = []
        size = 0
        for w in words:
            raw = w.encode("utf-8", "replace")
            if (k := self.ranks.get(raw)) is not None:
                self.known[w], self.decoded[w] = k.to_bytes(4, "little"), self.tokens[k]
                continue
            if todo and size + len(raw) > CHUNK:
                self._contract(todo)
                todo, size = [], 0
            todo.append((w, raw))
            size += len(raw)
        if todo:
            self._contract(todo)

    def _contract(self, todo: list[tuple[str, bytes]]) -> None:
        data = np.frombuffer(b"".join(raw for _, raw in todo), np.uint8)
        ids, pos = self.byte[data], np.arange(len(data), dtype=np.int32)
        ends = np.cumsum([len(raw) for _, raw in todo])
        first = np.append(True, ~self.touch[data[:-1], data[1:]])
        first[ends[:-1]] = True
        last = np.append(first[1:], True)
        piece = np.cumsum(first, dtype=np.int32) - np.int32(1)
        size = np.bincount(piece)[piece]
        after, next_id = np.where(last, -1, pos + 1).astype(np.int32), np.where(last, -1, np.append(ids[1:], -1)).astype(np.int32)
        made = [(pos[size == 1], ids[size == 1])]
        lots = [((size > 1) & (size <= LONG), CONTRACT)]
        if (long := np.flatnonzero(size > LONG)).size:  # these take more memory: fewer at a time, a longer piece alone
            new = np.flatnonzero(np.append(True, piece[long[1:]] != piece[long[:-1]]))
            lot = np.repeat(new // LONG_CHUNK, np.diff(np.append(new, len(long))))
            lots += [(long[lot == k], CONTRACT_LONG) for k in np.unique(lot)]
        for those, query in lots:
            if those.any():
                self.db.register("parts", pa.table({"piece": piece[those], "pos": pos[those], "id": ids[those], "next_pos": after[those], "next_id": next_id[those]}))
                got = self.db.execute(query).fetchnumpy()
                self.db.unregister("parts")
                made.append((np.asarray(got["pos"]), np.asarray(got["id"])))
        at, token = (np.concatenate(x) for x in zip(*made, strict=True))
        order = np.argsort(at)
        at, token = at[order], token[order].astype("<i4")
        self.db.register("contracted", pa.table({"pos": at, "id": token}))
        decoded = bytes.fromhex(self.db.execute(DECODED).fetchall()[0][0])
        self.db.unregister("contracted")
        to = np.searchsorted(at, np.append(0, ends))
        size = np.concatenate([[0], np.cumsum(self.sizes[token])])[to].tolist()
        raw, to = token.tobytes(), (4 * to).tolist()
        for i, (w, _) in enumerate(todo):
            self.known[w], self.decoded[w] = raw[to[i] : to[i + 1]], decoded[size[i] : size[i + 1]]

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        cut = [self.find(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
            self.decoded.clear()
        self.learn(set().union(*cut) - self.known.keys())
        for words in cut:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<i4"), b"".join(map(self.decoded.__getitem__, words))


def encode_decode(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text") -> DataFrame:
    """docs with ids array<int>, the token ids of the text, and decoded binary, what they decode to."""
    rest = docs.drop("ids", "decoded")
    spark: SparkSession = docs.sparkSession
    ranks = ranks_of(path)
    shared = spark.sparkContext.broadcast((ranks, merges_of(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or Encoder(*shared.value, pattern)
            ends, at = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)), 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + GROUP, side="right")))
                got = list(encode([x or "" for x in batch.column(text_col).slice(at, to - at).to_pylist()]))
                offsets = np.concatenate([[0], np.cumsum([len(g[0]) for g in got])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([g[0] for g in got]), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns, ids, pa.array([g[1] for g in got], pa.binary())], [*batch.schema.names, "ids", "decoded"])
                at = to

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "ids array<int>", "decoded binary"])
    return rest.mapInArrow(tidy(run), schema)


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """What the ids of op10_byte_bpe decode to: the texts."""
    return op10_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


ROUND_TRIP_SQL = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"
