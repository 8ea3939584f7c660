"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols. The leaves of its tree hold, for each symbol, the rank of the pair that
it forms with its right neighbour; inner nodes hold the minimum of (rank, place), so the root is the
leftmost pair of lowest rank. A merge changes at most three leaves, each updated along one path to
the root; it ends when the root holds no pair. Words of one size class (a power of two) are worked
on side by side, one tree per row of an array, so a word of n symbols takes n log n steps.

Words repeat, so each Python worker keeps the codes of words it has met lately, up to about `CACHE_WORDS`;
the cache only saves time.

Defined results: a null or empty text has no tokens and decodes to the empty text; special tokens
that stand in a text become their ids, as in the tokenizers library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from cyclelake.llm.common import free_names, map_rows, texts

NONE = np.int64(2**62)
CACHE_WORDS = 150_000
BLOCK_SYMBOLS = 1 << 18  # symbols encoded side by side

# --- fixed values: the white space of the vocabulary's normaliser ----------------------------
SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
# ---------------------------------------------------------------------------------------------


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next one free from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Vocabulary:
    """Symbols, merges and text rules of a vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        end = model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([self.ids[c] for c in letters], np.int64)
        self.last = np.array([self.ids[c + end] for c in letters], np.int64)
        pairs = np.array([(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in model["merges"]], np.int64)
        keys = (pairs[:, 0] << 32) | pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.rank, self.joined = keys[order], order.astype(np.int64), pairs[order, 2]
        self.by_rank = pairs[:, 2]
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.marks = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True)))
        self.known: dict[str, tuple[bytes, int, str]] = {}
        self.older: dict[str, tuple[bytes, int, str]] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is no merge (or where a side is missing, -1)."""
        keys = (left << 32) | (right & 0xFFFFFFFF)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.rank[at], NONE)


def merge_rows(vocabulary: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """Merge every row of symbols (-1: none) until no pair is left; merged-away places become -1."""
    rows, size = symbols.shape
    place_bits = size.bit_length()
    place = np.arange(size)
    following = np.where(np.arange(1, size + 1) < (symbols >= 0).sum(1)[:, None], np.arange(1, size + 1), -1)
    before = np.broadcast_to(np.arange(-1, size - 1), symbols.shape).copy()
    tree = np.full((rows, 2 * size), NONE, np.int64)
    right = np.concatenate([symbols[:, 1:], np.full((rows, 1), -1)], axis=1)
    leaf = vocabulary.ranks(symbols, right)
    tree[:, size:] = np.where(leaf < NONE, (leaf << place_bits) | place, NONE)
    level = size
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    def update(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        node = at + size
        tree[row, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def pair(row: np.ndarray, at: np.ndarray, then: np.ndarray) -> np.ndarray:
        rank = vocabulary.ranks(symbols[row, at], np.where(then >= 0, symbols[row, then], -1))
        return np.where(rank < NONE, (rank << place_bits) | at, NONE)

    active = np.nonzero(tree[:, 1] < NONE)[0]
    while len(active):
        root = tree[active, 1]
        at = root & (2**place_bits - 1)
        gone = following[active, at]
        then = following[active, gone]
        symbols[active, at] = vocabulary.by_rank[root >> place_bits]
        symbols[active, gone] = -1
        following[active, at] = then
        has = then >= 0
        before[active[has], then[has]] = at[has]
        update(active, gone, np.full(len(active), NONE))
        update(active, at, pair(active, at, then))
        previous = before[active, at]
        has = previous >= 0
        if has.any():
            update(active[has], previous[has], pair(active[has], previous[has], at[has]))
        active = active[tree[active, 1] < NONE]
    return symbols


def encode_words(vocabulary: Vocabulary, new: list[str]) -> None:
    """Add the codes of new words to the cache, size class by size class."""
    raw = [w.encode("utf-8", "surrogatepass") for w in new]
    classes: dict[int, list[int]] = {}
    for i, word in enumerate(raw):
        classes.setdefault(max(2, 1 << (len(word) - 1).bit_length()), []).append(i)
    for size, members in classes.items():
        step = max(1, BLOCK_SYMBOLS // size)
        for start in range(0, len(members), step):
            chosen = members[start : start + step]
            lengths = np.array([len(raw[i]) for i in chosen])
            filled = np.arange(size) < lengths[:, None]
            symbols = np.full((len(chosen), size), -1, np.int64)
            symbols[filled] = vocabulary.inner[np.frombuffer(b"".join(raw[i] for i in chosen), np.uint8)]
            ends = np.array([raw[i][-1] for i in chosen])
            symbols[np.arange(len(chosen)), lengths - 1] = vocabulary.last[ends]
            merged = merge_rows(vocabulary, symbols)
            counts = (merged >= 0).sum(1)
            flat = merged[merged >= 0]
            stops = np.cumsum(counts)
            codes, named = flat.astype("<u4").tobytes(), [vocabulary.tokens[t] for t in flat.tolist()]
            for i, stop, n in zip(chosen, stops.tolist(), counts.tolist(), strict=True):
                vocabulary.known[new[i]] = (codes[4 * (stop - n) : 4 * stop], n, " ".join(named[stop - n : stop]))


def normalise(text: str) -> str:
    """NFC, white space runs to one space, then lower case letter by letter (no rule for final sigma)."""
    text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def pieces(vocabulary: Vocabulary, text: str) -> list[str]:
    """Words of a text in order; special tokens stand for themselves."""
    if not text:
        return []
    if "<|" not in text:
        return vocabulary.split.findall(re.sub(SPACES, " ", normalise(text)) if not text.isascii() else normalise(text))
    out, start = [], 0
    for mark in vocabulary.marks.finditer(text):
        out += vocabulary.split.findall(re.sub(SPACES, " ", normalise(text[start : mark.start()])))
        out.append(mark.group())
        start = mark.end()
    return out + vocabulary.split.findall(re.sub(SPACES, " ", normalise(text[start:])))


@lru_cache(maxsize=4)
def vocabulary_at(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_batch(vocabulary: Vocabulary, batch: list[str]) -> list[tuple[bytes, int, str]]:
    """Per text: ids as little-endian 32-bit integers, their number, the decoded text."""
    parts = [pieces(vocabulary, t) for t in batch]
    if len(vocabulary.known) > CACHE_WORDS // 2:  # words not met since the last change are forgotten
        vocabulary.older, vocabulary.known = vocabulary.known, {}
    known, older = vocabulary.known, vocabulary.older
    fresh = {w for part in parts for w in part} - known.keys()
    met = fresh & older.keys()
    known.update((w, older[w]) for w in met)
    fresh -= met
    for mark in fresh & vocabulary.special.keys():
        known[mark] = (vocabulary.special[mark].to_bytes(4, "little"), 1, mark)
    encode_words(vocabulary, sorted(fresh - vocabulary.special.keys()))
    out = []
    for part in parts:
        found = [known[w] for w in part]
        ids = b"".join([f[0] for f in found])
        out.append((ids, len(ids) // 4, " ".join([f[2] for f in found])))
    return out


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """Tokens joined by a space: the file names no decoder, so word ends stay visible."""
    return " ".join([vocabulary.tokens[i] for i in ids.tolist()])


def encode(docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The kept columns, n_tokens, ids (little-endian unsigned 32-bit integers as bytes) and the decoded text of every row."""
    keep = ["doc_id"] if keep is None else keep
    (hidden,) = free_names(docs, "__text")
    kept = docs.select(*keep, F.col(text).alias(hidden))
    made = [StructField("n_tokens", LongType()), StructField("ids", BinaryType()), StructField("decoded", StringType())]

    def run(batch: pa.RecordBatch) -> dict:
        ids, counts, decoded = zip(*encode_batch(vocabulary_at(path), texts(batch, hidden)), strict=True)
        return {c: batch.column(c) for c in keep} | {"n_tokens": counts, "ids": ids, "decoded": decoded}

    return map_rows(kept, run, StructType([*kept.schema.fields[:-1], *made]))


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Key and decoded text of rows of ids as `encode` gives them; null ids decode to the empty text."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        rows = [np.frombuffer(x or b"", "<u4") for x in batch.column(ids).to_pylist()]
        return {key: batch.column(key), "decoded": [decode_ids(vocabulary_at(path), r) for r in rows]}

    return map_rows(encoded.select(key, ids), run, f"`{key}` {kind}, decoded string")
