"""Language identification by compression.

Each language gets a zstandard dictionary of raw text from its own learning rows. A document is
folded (lower case, everything but letters to one space), cut into blocks, and every block of the
whole text is compressed with each language's dictionary. The language with the smallest total
wins. Sizes are whole bytes, so short texts can tie; ties are broken by a finer search (matches
of three bytes) over all tails of the text that begin with a word, then by the frequency of the languages in the learning rows.

A document is rejected if its two smallest totals differ by a smaller share of the smallest than
``least``, or not at all, as is one without letters. Learning sets ``least`` by rows that are kept out of
the dictionaries, and texts of random letters, in the frequencies of these
rows, as long as the rows are. The share lies a little above what nearly all of the
random texts stay below, and never above what nearly all of the rows reach.

Learning reads a bounded, documented sample of rows, whole texts: for each language at most
``docs_per_language`` documents for its dictionary and ``judged`` more for the least margin, chosen by a hash
of their id, those of up to ``longest`` characters first, so that no few texts make up a dictionary. Prediction reads whole texts. Languages are the labels found, which are few. Letters are the
characters of Unicode's categories L; all others part words.

A null text or one without a letter is ``und`` with score 0; so is every text if no row has a
language to learn. Rows are independent, so repeated rows get equal answers. Columns of docs are
passed on; ones named lang_pred, score, margin or rejected are replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, table, tidy



def not_letters() -> re.Pattern:
    """Runs of anything but letters: what re has for words, less digits, underscores and other numbers."""
    odd = [i for i in range(0x110000) if (c := chr(i)).isalnum() and not c.isalpha() and not c.isdecimal()]
    runs: list[list[int]] = []
    for i in odd:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return re.compile(r"[\W\d_" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]+")


NOT_LETTERS = not_letters()
LEVEL, BLOCK = 9, 2048
#: Rows that say something about the least margin have so many letters at least.
LEAST_BYTES = 200
#: The least margin, in terms of the largest margins of random texts: documents are kept rather than lost.
NOISE = 1.2
#: The least margin where learning rows say nothing about it.
USUAL = 0.04
OUT = "lang_pred string, score double, margin int, rejected boolean"


def folded(text: str) -> bytes:
    words = NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {words} ".encode("utf-8", "replace") if words else b""


class Dictionaries(list):
    """(language, dictionary) pairs, and the least margin, as a share of the compressed size."""

    least = USUAL


def least_margin(dictionaries: list[tuple[str, bytes]], rows: list[bytes]) -> float:
    """The share of the compressed size that parts margins of folded rows from those of random letters."""
    rows = [r for r in rows if len(r) >= LEAST_BYTES]
    if len(dictionaries) < 2 or len(rows) < 20:
        return USUAL
    judge, rng = Classifier(dictionaries, 0.0), random.Random(7)
    texts = [r.decode("utf-8", "replace") for r in rows]
    letters = "".join(texts).replace(" ", "")
    noise = [" ".join("".join(rng.choices(letters, k=len(w))) for w in t.split()) for t in texts]
    share = lambda found: sorted(margin / size for margin, size in (judge.totals(folded(t))[1:] for t in found))
    clean, random_ones = share(texts), share(noise)
    low, high = clean[len(clean) // 100], random_ones[-1 - len(random_ones) // 100]
    return min(low, NOISE * high) if low > high > 0 else min(low, USUAL)


def learn(docs: DataFrame, learn_rows: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 110, judged: int = 80, longest: int = 2_000) -> Dictionaries:
    """(language, dictionary) pairs, most frequent language first."""
    rows = docs.filter(learn_rows & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit(7)).alias("h"), F.col(text_col).alias("part"))
    most = docs_per_language + judged
    often = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    # some times as many as wanted, by hash, so that no language's rows meet in one task
    share = F.create_map(*(x for k, v in often.items() for x in (F.lit(k), F.lit(min(1.0, 8 * most / v) * 1e6)))) if often else F.lit(None)
    some = rows.filter(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")]) if often else rows.limit(0)
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.char_length("part") > longest, "h", "part"))
    picked: dict[str, list[tuple[int, bytes]]] = {}
    for lang, n, part in some.withColumn("n", first).filter(F.col("n") <= most).select("lang", "n", "part").collect():
        picked.setdefault(lang, []).append((n, folded(part)))
    # where rows are few, every fourth is kept out
    share = {k: min(docs_per_language, len(v) - len(v) // 4) for k, v in picked.items()}
    made = {k: b"".join(x for n, x in sorted(v) if n <= share[k]) for k, v in picked.items()}
    found = Dictionaries((k, made[k]) for k in sorted(made, key=lambda k: (-often[k], k)) if made[k])
    found.least = least_margin(found, [x for k in sorted(picked) for n, x in sorted(picked[k]) if n > share[k]])
    return found


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]], least: float) -> None:
        import zstandard as z

        self.names, self.least, self.made, self.finer = [k for k, _ in dictionaries], least, [], []
        for _, raw in dictionaries:
            how = z.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(raw), write_content_size=0, write_checksum=0, write_dict_id=0)
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.made.append(z.ZstdCompressor(dict_data=d, compression_params=how))
            how = z.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(raw), write_content_size=0, write_checksum=0, write_dict_id=0, min_match=3, strategy=z.STRATEGY_BTULTRA2, target_length=256)
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.finer.append(z.ZstdCompressor(dict_data=d, compression_params=how))

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(x)) for x in blocks) for c in self.made]

    def totals(self, data: bytes) -> tuple[int, float, float]:
        """(best language, margin to the next, size) of a folded text, in bytes."""

        def ranked(sizes: list[int]) -> tuple[int, int, int]:
            best = min(range(len(sizes)), key=sizes.__getitem__)
            return best, min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] + 99) - sizes[best], sizes[best]

        best, margin, size = ranked(self.sizes(data))
        if margin or len(data) > BLOCK:
            return best, margin, size
        tails = [data[i:] for i in range(len(data) - 1) if data[i] == 32]
        best, finer, whole = ranked([sum(len(c.compress(x)) for x in tails) for c in self.finer])
        return best, size * finer / whole, size

    def __call__(self, text: str | None) -> tuple[str, float, int, bool]:
        data = folded(text or "")
        if not data or not self.made:
            return "und", 0.0, 0, True
        best, margin, size = self.totals(data)
        return self.names[best], margin / (margin + 4.0 + 0.01 * size), int(margin), margin == 0 or margin < self.least * size


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], *, text_col: str = "text", least: float | None = None) -> DataFrame:
    """docs with lang_pred, score (0 to 1), margin in bytes and rejected; least: what learning found,
    unless given."""
    share = getattr(dictionaries, "least", USUAL) if least is None else least
    dictionaries = list(dictionaries)
    new = [x.split()[0] for x in OUT.split(", ")]
    rest = docs.drop(*new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(dictionaries, share)
        for batch in batches:
            got = [judge(x.as_py()) for x in batch.column(text_col)]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), OUT])
    return rest.mapInArrow(tidy(run), schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_mod(F.col("doc_id"), 3) == 1
    known = learn(docs, ~held)
    out = identify(docs.select("doc_id", "text"), known)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
