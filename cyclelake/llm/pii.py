"""Personal data: base patterns, and candidates chosen by boosted trees.

Base spans are the matches of four patterns that pass their checks. They miss what stands next to other
digits (two card numbers side by side, a phone number before an address) or is written around the
pattern (name (at) host). So high-recall generators propose overlapping spans of the same kinds: every
window of digit groups that could be a card, address or phone number, every mark of an e-mail.

Boosted trees score the candidates from format and context. They learn from the corpus itself: where a
run of digits is one base span, that span is an example and its other windows are counterexamples;
where a run holds no base span, its windows are counterexamples; mixed runs teach nothing and are only
scored. All lessons are counted by kind, lesson and features, and the trees and thresholds are made of all of them, with
their counts as weights: on the driver while there are few distinct ones, beyond `HELD_LESSONS` by jobs over them. On a fifth of the texts held back, each kind gets the lowest threshold (half or more, halfway to the next score) at which
the chosen ones are right in at least `precision` of the cases (none: the kind adds nothing). Chosen spans do not overlap each other or a base
span; base spans always stay.

Defined results: a null or empty text has no spans; without candidates of both classes nothing is added.
Patterns run in linear time, so one very long text or word is no trap.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cyclelake.llm import boosting
from cyclelake.llm.common import in_arrow, map_rows, stored, texts

KINDS = ["email", "ip", "card", "phone"]
# --- fixed values: the base patterns (possessive or guarded forms of the same matches) ---------
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# -----------------------------------------------------------------------------------------------
DIGIT = re.compile("[0-9]")
GROUP = re.compile("[0-9]+")
HOST = re.compile("[A-Za-z0-9-]+")
RUN = re.compile(r"\+?[0-9][0-9\x20().\-]*")
WRITTEN_AT = re.compile(r"\s?(?:\(at\)|\[at\])\s?", re.IGNORECASE)
WRITTEN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]+)+", re.IGNORECASE)
HINTS = re.compile(r"(?i)\b(?:tel|phone|call|fax|mail|e-mail|contact|card|visa|credit|ip|host|addr|address)\b")
FEATURES = 22
HELD_LESSONS = 100_000  # distinct lessons that the driver takes as arrays
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(GROUP.findall(text))


def emails(text: str) -> list[Span]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by kind, then start."""
    found = emails(text)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(part) <= 3 and int(part or "0") <= 255 for part in (p.lstrip("0") for p in m.group().split("."))):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() <= 40 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(digits_of(m.group())) <= 15:
                    found.append(("phone", *m.span()))
    return found


def _side(text: str, at: int) -> int:
    """Class of the character beside a span: 0 none or white space, 1 letter, 2 digit, 3 quote, 4 other."""
    if not 0 <= at < len(text) or text[at].isspace():
        return 0
    c = text[at]
    return 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in "\"'`" else 4


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    own = text[start:end]
    groups = GROUP.findall(own)
    lengths = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    gaps = GROUP.split(own)[1:-1]
    octets = kind == "ip" and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    return [
        *(float(kind == k) for k in KINDS), len(digits), len(groups), max(lengths), min(lengths), lengths[0], lengths[-1],
        float(kind == "card" and luhn(digits)), float(octets), float(any(len(g) > 1 and g[0] == "0" for g in groups)),
        len(set(gaps)), max(map(len, gaps), default=0), _side(text, start - 1), _side(text, end), end - start,
        float(bool(HINTS.search(text, max(0, start - 24), start))), len(set(digits)),
        float(own.count(".")), float(own[-1:].isalpha()),
    ]


def _windows(text: str, run: re.Match) -> list[Span]:
    """Card, address and phone windows of consecutive digit groups; each start has at most 19."""
    groups = [m.span() for m in GROUP.finditer(text, run.start(), run.end())]
    found, plus = [], text[run.start()] == "+"
    for i, (start, _) in enumerate(groups):
        total, close, dots = 0, True, 0
        for j in range(i, len(groups)):
            total += groups[j][1] - groups[j][0]
            if j > i:
                gap = text[groups[j - 1][1] : groups[j][0]]
                close &= gap in (" ", "-")
                dots += gap == "."
            if total > 19:
                break
            end, many = groups[j][1], j - i + 1
            if close and total >= 13:
                found.append(("card", start, end))
            if many == 4 and dots == 3:
                found.append(("ip", start, end))
            if 9 <= total <= 15 and not (many == 4 and dots == 3) and (plus and i == 0 or 3 <= many <= 5 and total in (10, 11)):
                found.append(("phone", run.start() if plus and i == 0 else start, end))
    return found


def candidates(text: str, base: list[Span]) -> list[tuple[Span, int]]:
    """Spans of the generators, each with its lesson: 1 example, 0 counterexample, -1 only to be scored."""
    found: list[tuple[Span, int]] = []
    if DIGIT.search(text):
        held = sorted((s, e, k) for k, s, e in base if k != "email")
        at = 0
        for run in RUN.finditer(text):
            windows = _windows(text, run) if run.end() - run.start() >= 7 else []
            if not windows:
                continue
            while at < len(held) and held[at][1] <= run.start():
                at += 1
            inside = [h for h in held[at : at + 64] if h[0] < run.end()]
            last = max(m.end() for m in GROUP.finditer(text, run.start(), run.end()))
            whole = {(k, s, e) for s, e, k in inside if s == run.start() and e == last}
            found += [(w, 1 if w in whole else 0 if whole or not inside else -1) for w in windows]
    found += [(span, 1) for span in base if span[0] == "email"]
    at = text.find("@")
    taken = sorted(e for k, _, e in base if k == "email")
    while at >= 0:  # a name and a host without a dot
        host = HOST.match(text, at + 1)
        after = bisect_right(taken, at)
        if host and at and LOCAL.match(text, at - 1) and not (after < len(taken) and taken[after] <= at + 255):
            found.append((("email", _local_start(text, at), host.end()), 0))
        at = text.find("@", at + 1)
    for mark in WRITTEN_AT.finditer(text) if "at" in text.lower() and ("(" in text or "[" in text) else ():
        domain = WRITTEN_DOMAIN.match(text, mark.end())
        if domain and mark.start() and LOCAL.match(text, mark.start() - 1):
            found.append((("email", _local_start(text, mark.start()), domain.end()), -1))
    return found


def _local_start(text: str, at: int) -> int:
    while at and LOCAL.match(text, at - 1):
        at -= 1
    return at


SCANNED = "base array<struct<kind: string, start: int, end: int>>, candidates array<struct<kind: string, start: int, end: int, lesson: int, x: array<float>>>"


def scan_text(text: str) -> tuple[list[Span], list[tuple[Span, int, list[float]]]]:
    base = base_spans(text)
    return base, [(span, lesson, describe(text, span)) for span, lesson in candidates(text, base)]


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with the base spans and the described candidates of every text."""
    kept = docs.select(*keep, F.col(text).alias("__text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text"]

    def run(batch: pa.RecordBatch) -> dict:
        made = [scan_text(t) for t in texts(batch, "__text")]
        return {c: batch.column(c) for c in keep} | {
            "base": [[{"kind": k, "start": s, "end": e} for k, s, e in base] for base, _ in made],
            "candidates": [[{"kind": k, "start": s, "end": e, "lesson": y, "x": x} for (k, s, e), y, x in found] for _, found in made],
        }

    return map_rows(kept, run, ", ".join([*schema, SCANNED]))


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted((s, e) for _, s, e in spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


@dataclass(frozen=True)
class Selector:
    trees: boosting.Boosted | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def chosen(self, base: list[Span], found: list[tuple[Span, list[float]]]) -> list[Span]:
        """All spans of a text by kind, then start: the base and the candidates that pass."""
        known = set(base)
        out, open_ = list(base), [(span, x) for span, x in found if span not in known]
        if self.trees and open_:
            p = boosting.sigmoid(self.trees.margin(np.array([x for _, x in open_], float)))
            starts, taken = _merged(base)
            for _, span in sorted((-q, span) for q, (span, _) in zip(p, open_, strict=True) if q >= self.thresholds.get(span[0], 2.0)):
                at = bisect_right(starts, span[1])
                if (at == 0 or taken[at - 1] <= span[1]) and (at == len(starts) or starts[at] >= span[2]):
                    out.append(span)
                    starts.insert(at, span[1])
                    taken.insert(at, span[2])
        return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def lessons(scanned: DataFrame) -> DataFrame:
    """Distinct (kind, lesson, x) of all candidates that teach, with their number and the number held back."""
    held = F.pmod("row", F.lit(5)) == 0  # whole texts, as the windows of one run overlap
    one = scanned.select(F.xxhash64("candidates").alias("row"), F.explode("candidates").alias("c")).where("c.lesson >= 0")
    return one.select("*", "c.kind", "c.lesson", "c.x").withColumn("held", held).groupBy("kind", "lesson", "x").agg(
        F.count("*").alias("n"), F.count_if("held").alias("n_held")
    )


def sampled_lessons(scanned: DataFrame, max_rows: int) -> list[tuple]:
    """At most `max_rows` distinct (kind, lesson, x) with the weights of their candidates for training and held back, to look at; `fit` takes all.

    All candidates are counted. A kind and lesson with more than its part of `max_rows` distinct vectors keeps
    those of highest priority n / u, u a hash of the vector; a kept one weighs max(n, the first priority left
    out), so frequent vectors count as they are and sums over the others have no bias.
    """
    u = F.xxhash64("kind", "lesson", "x").bitwiseAND(F.lit((1 << 52) - 1)) + 1
    ranked = stored(lessons(scanned).withColumn("priority", F.col("n") / (u / F.lit(float(1 << 52)))))
    part, out = max(1, max_rows // (2 * len(KINDS))), []
    for kind in KINDS:
        for lesson in (0, 1):
            own = ranked.where((F.col("kind") == kind) & (F.col("lesson") == lesson))
            rows = own.orderBy(F.desc("priority"), "x").limit(part + 1).collect()
            least = rows[part].priority if len(rows) > part else 0.0
            for r in rows[:part]:
                scale = max(1.0, least / r.n)
                out.append((kind, lesson, list(r.x), (r.n - r.n_held) * scale, r.n_held * scale))
    return out


def fit(scanned: DataFrame, precision: float = 0.98, held_lessons: int = HELD_LESSONS) -> Selector:
    """Trees and thresholds from all lessons of a stored scan, weighted by their candidates."""
    counted = stored(lessons(scanned))
    taught = counted.where("n > n_held").select("x", F.col("lesson").alias("y"), (F.col("n") - F.col("n_held")).alias("weight"))
    if taught.select("y").distinct().count() < 2:
        return Selector()
    if counted.count() > held_lessons:
        trees = boosting.fit_rows(stored(taught))
        return Selector(trees, _thresholds_of_rows(counted, trees, precision))
    rows = sorted((r.kind, r.lesson, list(r.x), r.n - r.n_held, r.n_held) for r in counted.collect())  # at most `held_lessons`
    train = [r for r in rows if r[3] > 0]
    trees = boosting.fit(*(np.array([r[at] for r in train], float) for at in (2, 1)), weight=np.array([r[3] for r in train], float))
    thresholds = {}
    held = [(*r[:3], r[4]) for r in rows if r[4] > 0] or [r[:4] for r in train]
    p = boosting.sigmoid(trees.margin(np.array([x for _, _, x, _ in held], float)))
    for kind in KINDS:
        own = sorted(((q, y, w) for q, (k, y, _, w) in zip(p, held, strict=True) if k == kind), reverse=True)
        right = total = 0
        for n, (q, lesson, weight) in enumerate(own, 1):
            right, total = right + lesson * weight, total + weight
            if right >= precision * total and (n == len(own) or own[n][0] < q):
                thresholds[kind] = max(0.5, (q + own[n][0]) / 2 if n < len(own) else 0.5)
    return Selector(trees, thresholds)


def _thresholds_of_rows(counted: DataFrame, trees: boosting.Boosted, precision: float) -> dict[str, float]:
    """The thresholds `fit` takes of arrays, from running sums over the distinct scores of each kind."""
    weighed = counted.where("n_held > 0").select("kind", "x", F.col("lesson").alias("y"), F.col("n_held").alias("weight"))
    if weighed.isEmpty():
        weighed = counted.select("kind", "x", F.col("lesson").alias("y"), F.col("n").alias("weight"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, weight = boosting.columns_of(batch, FEATURES)
            q = boosting.sigmoid(trees.margin(x))
            made = [batch.column("kind"), pa.array(q), pa.array((y * weight).astype(np.int64)), pa.array(weight.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(made, ["kind", "q", "right", "total"])

    each = in_arrow(weighed, scored, "kind string, q double, right long, total long").groupBy("kind", "q").agg(F.sum("right").alias("right"), F.sum("total").alias("total"))
    down = Window.partitionBy("kind").orderBy(F.desc("q"))  # a row per distinct score
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    swept = each.select("kind", "q", F.lead("q").over(down).alias("below"), F.sum("right").over(upto).alias("right"), F.sum("total").over(upto).alias("total"))
    least = swept.where(F.col("right") >= F.lit(precision) * F.col("total")).groupBy("kind").agg(F.min_by(F.struct("q", "below"), "q").alias("at"))
    return {r.kind: max(0.5, (r.at.q + r.at.below) / 2 if r.at.below is not None else 0.5) for r in least.collect()}  # a row per kind


def _spans(rows: list[dict]) -> list[Span]:
    return [(r["kind"], r["start"], r["end"]) for r in rows]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def select(scanned: DataFrame, selector: Selector, keep: list[str]) -> DataFrame:
    """The kept columns, base counts per kind, base and all spans as text."""
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in scanned.select(*keep).schema]

    def run(batch: pa.RecordBatch) -> dict:
        base = [_spans(rows) for rows in batch.column("base").to_pylist()]
        found = [[((c["kind"], c["start"], c["end"]), c["x"]) for c in rows] for rows in batch.column("candidates").to_pylist()]
        counts = {f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in KINDS}
        return {c: batch.column(c) for c in keep} | counts | {
            "base_spans": [written(b) for b in base],
            "spans": [written(selector.chosen(b, f)) for b, f in zip(base, found, strict=True)],
        }

    return map_rows(scanned, run, ", ".join([*schema, *(f"n_{k} long" for k in KINDS), "base_spans string", "spans string"]))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, selector: Selector, text: str = "text") -> DataFrame:
    """All columns of the documents with the chosen spans replaced in the text; a null text stays null."""

    def run(batch: pa.RecordBatch) -> dict:
        made = []
        for one in batch.column(text).to_pylist():
            base, found = scan_text(one or "")
            spans = selector.chosen(base, [(span, x) for span, _, x in found])
            made.append(redacted(one, spans) if spans else one)
        return {c: batch.column(c) for c in batch.schema.names} | {text: made}

    return map_rows(docs, run, docs.schema)
