"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case words (letters and digits) joined by one space, so case, marks and line
breaks do not matter. An item of m characters may be met with k = floor(rate * m) edits anywhere in a
document. Cut into k + 1 pieces, it leaves at least one piece whole, wherever k edits fall: exact
hits of the pieces (one automaton over all pieces) give windows, and Myers' bit-parallel distance
verifies each window. Nothing within the budget is missed and nothing beyond it is reported.

Items are sent to the tasks in blocks of at most `block_chars` characters; each block meets all documents.

Defined results: items without words match nothing; items shorter than `exact_below` characters must
occur whole, at word borders, without edits; null and empty texts hold no item; items with equal texts
and documents with equal keys are reported each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cyclelake.llm.common import in_arrow, sliced, texts

WORDS = re.compile(r"[^\W_]+")
RATE = 0.08
EXACT_BELOW = 40
BLOCK_CHARS = 4_000_000


def plain(text: str | None) -> str:
    """Lower-case words joined by one space."""
    return " ".join(WORDS.findall((text or "").lower()))


def cut(item: str, parts: int) -> list[tuple[int, str]]:
    """(offset, piece) of an item cut into parts of nearly equal length."""
    edges = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Pattern:
    """An item with its error budget and the bit masks of Myers' algorithm."""

    def __init__(self, text: str, rate: float = RATE, exact_below: int = EXACT_BELOW):
        self.text = text
        self.budget = int(rate * len(text)) if len(text) >= exact_below else 0
        self.whole = len(text) < exact_below
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, start: int, stop: int) -> tuple[int, int]:
        """Smallest edit distance to any substring of text[start:stop], and where that substring ends."""
        m = len(self.text)
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score, best, end = full, 0, m, m, start
        masks = self.masks
        for at in range(start, stop):
            eq = masks.get(text[at], 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph, mh = minus | (full & ~(xh | plus)), plus & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best, end = score, at + 1
            ph, mh = ph << 1 & full, mh << 1 & full
            plus, minus = mh | (full & ~(xv | ph)), ph & xv
        return best, end


class Matcher:
    """All items of a block behind one automaton over their pieces."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE, exact_below: int = EXACT_BELOW):
        self.items = [(key, Pattern(text, rate, exact_below)) for key, text in items if text]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (_, pattern) in enumerate(self.items):
            for offset, piece in cut(pattern.text, pattern.budget + 1):
                pieces.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item key, distance, budget, end in the plain text) of every item within its budget."""
        if not text or not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        for last, (length, places) in self.automaton.iter(text):
            for i, offset in places:
                pattern = self.items[i][1]
                start = last + 1 - length - offset - pattern.budget
                stop = start + len(pattern.text) + 2 * pattern.budget
                known = windows.setdefault(i, [])
                if known and start <= known[-1][1] and start >= known[-1][0]:
                    known[-1][1] = max(known[-1][1], stop)
                else:
                    known.append([start, stop])
        found = []
        for i, spans in windows.items():
            key, pattern = self.items[i]
            best, end = len(pattern.text) + 1, 0
            for start, stop in spans:
                if pattern.whole:
                    stop = min(stop, len(text))
                    hit = self._bordered(text, pattern.text, max(0, start), stop)
                    distance, at = (0, hit) if hit else (best, end)
                else:
                    distance, at = pattern.best(text, max(0, start), min(len(text), stop))
                if distance < best:
                    best, end = distance, at
                if best == 0:
                    break
            if best <= pattern.budget:
                found.append((key, best, pattern.budget, end))
        return found

    @staticmethod
    def _bordered(text: str, item: str, start: int, stop: int) -> int:
        """End of the first occurrence of the item in a window, at word borders; 0 if there is none."""
        at = text.find(item, start, stop)
        while at >= 0:
            end = at + len(item)
            if (at == 0 or text[at - 1] == " ") and (end == len(text) or text[end] == " "):
                return end
            at = text.find(item, at + 1, stop)
        return 0


def item_blocks(benchmark: DataFrame, item: str, text: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """Items in plain form, in blocks of bounded size."""
    block, chars = [], 0
    for key, raw in benchmark.select(item, text).toLocalIterator():
        form = plain(raw)
        if block and chars + len(form) > block_chars:
            yield block
            block, chars = [], 0
        block.append((key, form))
        chars += len(form)
    if block:
        yield block


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    rate: float = RATE, exact_below: int = EXACT_BELOW, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """A row per document and item that it holds: key, item_id, distance, budget, end (in the plain text)."""
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"`{key}` {kinds[0]}, item_id {kinds[1]}, distance int, budget int, end int"
    kept, item_type = docs.select(key, F.col(text).alias("__text")), to_arrow_type(benchmark.schema[item].dataType)

    def of(block: list[tuple[object, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate, exact_below)
            for batch in sliced(batches):
                at, rows = [], []
                for i, one in enumerate(texts(batch, "__text")):
                    hits = matcher.find(plain(one))
                    at += [i] * len(hits)
                    rows += hits
                if rows:
                    item_ids, *numbers = zip(*rows, strict=True)
                    columns = [batch.column(0).take(pa.array(at)), pa.array(item_ids, item_type), *(pa.array(n, pa.int32()) for n in numbers)]
                    yield pa.RecordBatch.from_arrays(columns, [key, "item_id", "distance", "budget", "end"])

        return in_arrow(kept, run, schema)

    found = None
    for block in item_blocks(benchmark, item, item_text, block_chars):
        found = of(block) if found is None else found.union(of(block))
    return of([]) if found is None else found


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    rate: float = RATE, exact_below: int = EXACT_BELOW, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The documents, with all columns, that hold no item."""

    def clean(kept: DataFrame, block: list[tuple[object, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate, exact_below)
            for batch in sliced(batches):
                yield batch.filter(pa.array([not matcher.find(plain(t)) for t in texts(batch, text)], pa.bool_()))

        return in_arrow(kept, run, kept.schema)

    for block in item_blocks(benchmark, item, item_text, block_chars):
        docs = clean(docs, block)
    return docs
