import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import awkward_texts, documents, prose, write

from cyclelake.llm import boosting, pii, queries


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def plain_base(text):
    bare = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(bare(m)) <= 19 and luhn(bare(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(bare(m)) <= 15]
    return out


def test_base_equals_the_patterns():
    r = random.Random(2)
    for _ in range(20_000):
        text = "".join(r.choice("01234567890123456789 --..++()@@ab.c%_é\n") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == plain_base(text), text


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000 + "@", "+1" + "(" * 300_000, "1.1 " * 100_000, "a@" * 100_000])
def test_very_long_texts_are_no_trap(text):
    pii.scan_text(text)


def card(r):
    body = "".join(r.choice("0123456789") for _ in range(15))
    return next(body + d for d in "0123456789" if luhn(body + d))


def private(i):
    r = random.Random(i)
    phone = f"+1 ({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}"
    address = ".".join(str(r.randint(1, 255)) for _ in range(4))
    own = [phone, address, card(r), f"{prose(i, 1)}.{i}@mail.example.com", "".join(r.choice("0123456789") for _ in range(16))]
    r.shuffle(own)
    return " ".join(f"{prose(i * 7 + j, 6)} {x}," for j, x in enumerate(own))


def test_query_keeps_base_spans_and_adds_hidden_ones(spark, tmp_path):
    r = random.Random(5)
    side_by_side = f"pay {card(r)} {card(r)} now"
    beside = "call +1 (826) 555-4081 190.137.223.204 soon"
    texts = [private(i) for i in range(150)] + [side_by_side, beside] + awkward_texts()
    rows = documents(spark, texts, tmp_path)
    found = queries.op6_boosted_pii(spark, str(tmp_path)).collect()
    written = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    expected = Counter()
    for key, text, *_ in rows:
        base = plain_base(text or "")
        counts = tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        expected[(key, *counts, hashlib.sha256(written(base).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found) == expected
    spans = {r.doc_id: r.spans for r in found}
    assert spans[150] == "card:4:20,card:21:37"
    assert spans[151] == "ip:23:38,phone:5:22"
    for key, text, *_ in rows:
        if key is not None:
            assert {written([span]) for span in plain_base(text or "")} <= set(spans[key].split(","))
    clean = [r.spans for r in found if r.doc_id is not None and r.doc_id >= 152]
    assert set(clean) == {""}


def test_redaction_keeps_all_columns(spark, tmp_path):
    documents(spark, [private(i) for i in range(60)] + awkward_texts(), tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = pii.redact(docs, pii.fit(pii.scan(docs, ["doc_id"])))
    assert out.schema == docs.schema and out.count() == docs.count()
    assert not [r for r in out.collect() if plain_base(r.text or "")]
    assert pii.redacted("a b c d", [("ip", 2, 5), ("card", 4, 7)]) == "a [IP]"


def test_trees_learn_a_rule():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.2) & (x[:, 3] < 0.5)).astype(float)
    model = boosting.fit(x[:1500], y[:1500])
    assert ((boosting.sigmoid(model.margin(x[1500:])) > 0.5) == y[1500:]).mean() > 0.97


def test_lessons_are_spread_over_vectors_and_weigh_as_counted(spark):
    vector = lambda kind, i: [float(kind == k) for k in pii.KINDS] + [float(i)] * (pii.FEATURES - 4)
    rows = []
    for at in range(3000):
        one = [("card", at + 20 * j, at + 20 * j + 9, at % 2, vector("card", at % 2)) for j in range(5)]
        one.append(("phone", 200, 220, at % 2, vector("phone", at % 50)))
        rows.append(([], one if at % 3 else one[:5]))
    scanned = spark.createDataFrame(rows, pii.SCANNED)
    found = pii.sampled_lessons(scanned, 1000)
    expected = Counter((k, y, tuple(x)) for _, cs in rows for k, _, _, y, x in cs)
    assert {(k, y, tuple(x)): round(a + b) for k, y, x, a, b in found} == expected and len(expected) == 52
    assert all(a > 0 for *_, a, _ in found) and sum(b for *_, b in found) > 0
    few = pii.sampled_lessons(scanned, 80)  # ten vectors of each kind and lesson
    assert Counter((k, y) for k, y, *_ in few) == {("card", 0): 1, ("card", 1): 1, ("phone", 0): 10, ("phone", 1): 10}
    assert sum(a + b for k, _, _, a, b in few if k == "card") == 15_000
    phones = sum(a + b for k, _, _, a, b in few if k == "phone")
    assert 1200 < phones < 2800  # 2,000 of them, estimated from twenty vectors


def test_weights_count_as_repeated_rows():
    rng = np.random.default_rng(4)
    x, n = rng.normal(size=(200, 3)), rng.integers(1, 5, 200)
    y = (x[:, 1] > 0).astype(float)
    weighted, repeated = boosting.fit(x, y, weight=n.astype(float)), boosting.fit(np.repeat(x, n, 0), np.repeat(y, n))
    assert abs(weighted.start - repeated.start) < 1e-12


def test_empty_table(spark, tmp_path):
    write(spark, [], "doc_id long, text string", tmp_path, "documents")
    assert queries.op6_boosted_pii(spark, str(tmp_path)).collect() == []


def test_very_long_parts_and_many_addresses():
    long = "0" * 5_000 + "7.1.2.3 and 1.2.3." + "9" * 5_000
    assert ("ip", 0, 5_007) in pii.base_spans(long) and len([s for s in pii.base_spans(long) if s[0] == "ip"]) == 1
    text = " ".join(f"user{i}@host{i}.example.org name{i}@plain" for i in range(100_000))
    started = time.monotonic()
    base, found = pii.scan_text(text)
    assert len(base) == 100_000 and len(found) == 100_001
    selector = pii.Selector(None, {})
    assert selector.chosen(base, [(span, x) for span, _, x in found]) == base
    assert time.monotonic() - started < 60


def test_chosen_spans_do_not_overlap():
    class Margins:
        def margin(self, x):
            return x[:, 0]

    base = [("ip", 10, 20), ("ip", 30, 40), ("card", 15, 25)]
    found = [(("phone", s, e), [m]) for s, e, m in [(0, 10, 9.0), (24, 31, 8.0), (25, 30, 7.0), (26, 29, 6.0), (40, 50, 5.0), (45, 60, 4.0), (60, 61, 3.0)]]
    chosen = pii.Selector(Margins(), {"phone": 0.5}).chosen(base, found)
    assert [s for s in chosen if s[0] == "phone"] == [("phone", 0, 10), ("phone", 25, 30), ("phone", 40, 50), ("phone", 60, 61)]


def test_fit_by_jobs_equals_fit_by_arrays(spark):
    """Beyond `held_lessons` distinct ones the same trees and thresholds come from jobs over all of them."""
    rng = np.random.default_rng(8)
    x = np.hstack([np.tile([0.0, 0.0, 1.0, 0.0], (900, 1)), rng.normal(size=(900, pii.FEATURES - 4)).astype(np.float32)])
    y = (x[:, 4] + 0.6 * x[:, 9] + 0.3 * rng.normal(size=900) > 0.4).astype(int)
    repeats = rng.integers(1, 6, 900)
    lessons = [("card", i, i + 9, int(y[i]), x[i].tolist()) for i in range(900) for _ in range(repeats[i])]
    scanned = spark.createDataFrame([([], lessons[i::150]) for i in range(150)], pii.SCANNED).localCheckpoint()
    held, spread = pii.fit(scanned), pii.fit(scanned, held_lessons=100)
    assert held.trees.start == spread.trees.start and len(held.trees.trees) == len(spread.trees.trees) == 40
    assert np.allclose(held.trees.margin(x), spread.trees.margin(x))
    assert held.thresholds == pytest.approx(spread.thresholds) and held.thresholds


def test_fit_takes_more_lessons_than_a_sample(spark):
    wide = spark.range(45_000).select(
        F.array().cast("array<struct<kind: string, start: int, end: int>>").alias("base"),
        F.array(F.struct(F.lit("card").alias("kind"), F.lit(0).alias("start"), F.lit(9).alias("end"), (F.col("id") % 2).cast("int").alias("lesson"),
                         F.array(*[F.col("id").cast("float")] * pii.FEATURES).alias("x"))).alias("candidates"),
    )
    seen = []
    original = boosting.fit
    boosting.fit = lambda x, *a, **k: seen.append(len(x)) or original(x, *a, rounds=1, **k)
    try:
        pii.fit(wide)
    finally:
        boosting.fit = original
    assert seen[0] > 30_000
