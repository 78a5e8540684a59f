"""Word shingles of whole texts, as sorted 64-bit hashes and, among a few texts, as exact numbers.

Words are the pieces between ASCII white space, with A to Z in lower case. A word's hash is 64 bits of
BLAKE2b, so that no two words can be made to collide short of trying some 2 ** 32 of them, and a
shingle's hash mixes those of its words. Numbers that stand for shingles exactly are dealt out among
the texts that are compared (`exact`)."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
FACTORS = [U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
#: Words whose hashes a task keeps.
CACHE = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only, as they should."""
    return (text or "").encode("utf-8", "replace").lower().split()


class Known(dict):
    """Words to hashes, worked out when they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return found


class Hasher:
    def __init__(self, words: int = 4) -> None:
        self.words, self.known = words, Known()

    def one(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingle hashes of a text; none for a null or a text without words."""
        split = words_of(text)
        if not split:
            return np.zeros(0, U)
        if len(self.known) > CACHE:
            self.known.clear()
        word = np.frombuffer(array("Q", map(self.known.__getitem__, split)), U)
        n = self.words
        with np.errstate(over="ignore"):
            if len(word) < n:  # the whole sequence as one
                few = U(len(word))
                for x in word:
                    few = mix(np.array([few * FACTORS[1] + x], U))[0]
                return np.array([few], U)
            whole = np.zeros(len(word) - n + 1, U)
            for i in range(n):
                whole += word[i : i + len(whole)] * (FACTORS[i % 4] * U(2 * i + 1))
            return np.unique(mix(whole))

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        return (self.one(x.as_py()) for x in column)


def fingerprint(s: np.ndarray) -> int:
    """64 bits that stand for a set, as a signed integer."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s + U(1)).sum(dtype=U) + U(len(s)) * FACTORS[2]], U)).view(np.int64)[0])


def exact(texts: list[str], words: int = 4) -> list[np.ndarray]:
    """Sets of shingles as sorted numbers, equal where the words are, among these texts."""
    number: dict[bytes, int] = {}
    split = [words_of(t) for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in split])])
    cur = np.fromiter((number.setdefault(w, len(number)) for x in split for w in x), np.int64, int(at[-1]))
    have = 1
    while have < words and len(cur):  # numbers of runs of `have` words, from those of shorter runs
        more = min(have, words - have)
        pairs = cur[: max(0, len(cur) - more)] * (cur.max() + 1) + cur[more:]
        cur, have = np.unique(pairs, return_inverse=True)[1].reshape(-1), have + more
    top, out = len(cur), []
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        out.append(np.unique(cur[a : b - words + 1]) if b - a >= words else np.array([top + i][: b - a], np.int64))
    return out
