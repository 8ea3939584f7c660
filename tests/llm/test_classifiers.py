import math
import random
from collections import Counter

import numpy as np
import pytest
from tables import RUDE, awkward_texts, crc, documents, prose, write

from cyclelake.llm import quality, queries, toxicity

LABELS = "doc_id long, quality int, toxic int, label string"


def labelled(spark, path, texts, of):
    rows = documents(spark, texts, path)
    labels = [(k, *of(t), "x") for k, t, *_ in rows if k is not None] + [(0, 1, 0, "x"), (None, 1, 1, "x"), (1, None, None, "x"), (10**9, 0, 0, "x")]
    write(spark, labels, LABELS, path, "labels")
    return rows


def test_quality_learns_and_scores_every_row(spark, tmp_path):
    junk = lambda t: " ".join(w + "***" for w in t.split())
    texts = [junk(prose(i, 80)) if i % 3 == 0 else prose(i, 80) for i in range(150)] + awkward_texts()
    rows = labelled(spark, tmp_path, texts, lambda t: (int("***" not in (t or "")), 0))
    found = queries.op2_quality(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (crc(r.doc_id) % 5 == 0)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 150]
    assert len(held) > 10 and all(r.predicted == int(r.doc_id % 3 != 0) for r in held)


def test_ftrl_equals_the_plain_update():
    p = quality.Ftrl(bits=10)
    rows = [("a b b c", 1), ("c d ***", 0), ("", 1), ("a a a", 0)] * 2
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= p.l1 else -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for text, y in rows:
        at = quality.features(text, p.bits).tolist()
        x = {i: c * quality.SCALE / len(at) for i, c in Counter(at).items()} | {2**p.bits: 1.0}
        w = {i: weight(i) for i in x}
        error = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x))) - y
        for i in x:
            g = error * x[i]
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha
            z[i] += g - s * w[i]
            n[i] += g * g
    learned = quality.train(rows, p)
    assert learned == pytest.approx([weight(i) for i in range(2**p.bits + 1)], abs=1e-9)


def test_nearest_examples_equal_a_full_search():
    r = random.Random(1)
    vectors = []
    for _ in range(700):
        v = {t: r.choice([1.0, 1.0, 2.0, 0.5]) for t in r.sample(range(40), r.randint(1, 5))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / norm for t, x in v.items()})
    index = toxicity.BlockMaxIndex(vectors, 40, 16)
    dense = np.zeros((700, 40))
    for i, v in enumerate(vectors):
        dense[i, list(v)] = list(v.values())
    for i in range(0, 700, 7):
        cosines = dense @ dense[i]
        order = sorted((j for j in range(700) if j != i and cosines[j] > 1e-12), key=lambda j: (-round(cosines[j], 12), j))[:10]
        found, got = index.nearest(vectors[i], 10, without=i)
        assert found.tolist() == order
        assert got == pytest.approx(cosines[order])


def test_toxicity_finds_rude_texts_and_leaves_others(spark, tmp_path):
    def text(i):
        own = prose(i, 60).split()
        if i % 4 == 0:
            own[10:10] = [RUDE[i % 3].upper() + ",", RUDE[(i + 1) % 3]]
        return " ".join(own)

    texts = [text(i) for i in range(400)] + awkward_texts()
    rows = labelled(spark, tmp_path, texts, lambda t: (1, int(any(w in (t or "").lower() for w in RUDE))))
    found = queries.op5_toxic_neighbours(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    for r in found:
        rude = r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4 == 0
        assert r.predicted == int(rude) == int(r.score >= 0.3) and 0 <= r.score <= 1
        assert r.held_out == (crc(r.doc_id) % 4 == 2)
        assert bool(r.evidence) == rude


@pytest.mark.parametrize("query", [queries.op2_quality, queries.op5_toxic_neighbours])
def test_empty_tables(spark, tmp_path, query):
    write(spark, [], "doc_id long, text string", tmp_path, "documents")
    write(spark, [], LABELS, tmp_path, "labels")
    assert query(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize(("query", "score"), [(queries.op2_quality, quality.PRIOR), (queries.op5_toxic_neighbours, 0.0)])
def test_without_labels(spark, tmp_path, query, score):
    documents(spark, awkward_texts(), tmp_path)
    write(spark, [(1, None, None, "x")], LABELS, tmp_path, "labels")
    assert {r.score for r in query(spark, str(tmp_path)).collect()} == {score}


def test_document_frequencies(spark):
    rows = [([0, 2],), ([2],), ([],), ([1, 2, 4],)] * 5
    counted = spark.createDataFrame(rows, "terms array<int>").repartition(3)
    assert toxicity.document_frequencies(counted, 6).tolist() == [5, 5, 15, 0, 5, 0]
    assert toxicity.document_frequencies(counted.limit(0), 2).tolist() == [0, 0] and len(toxicity.document_frequencies(counted.limit(0), 0)) == 0
