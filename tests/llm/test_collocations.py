import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from tables import awkward_texts, documents, write

from cyclelake.llm import collocations, queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=2000):
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for size in (1, 2, 3):
                counts.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    out = {}
    for key, a in counts.items():
        lang, *words = key
        if len(words) == 1 or a < 10:
            continue
        if len(words) == 2 and any(
            len(k) == 4 and k[0] == lang and f >= 10 and 100 * f >= 50 * a and (k[1:3] == key[1:] or k[2:] == key[1:]) for k, f in counts.items()
        ):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, rank, p.decode(), -a, left, right, sizes[lang], -s)
        for lang, found in out.items()
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    }


def few_words(seed, n, vocabulary=12):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghijklmnopqrst"[:vocabulary]) + r.choice(["", "", "", ".", ",", "\n", " \t"]) for _ in range(n))


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    made = [few_words(i, 150) for i in range(30)] + ["New York City has New York City marks! " * 12, "É é É é É é " * 9, ".,;:!?\r\n\x0b\x0c"]
    rows = documents(spark, made + awkward_texts(), tmp_path)
    found = queries.op11_collocations(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in found} == brute([(r[2], r[1]) for r in rows])
    assert len(found) > 200
    with duckdb.connect() as connection:
        connection.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert sorted(connection.sql(queries.OP11_SQL).fetchall()) == sorted(map(tuple, found))


@pytest.mark.parametrize("hot", [1, 5, 30])
def test_unranked_words_and_pairs_give_the_same(spark, hot):
    rows = [("en" if i % 3 else None, few_words(i, 200, 16)) for i in range(20)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert {tuple(r) for r in collocations.collocations(docs, hot=hot, top=50).collect()} == brute(rows, 50)


def test_tiles_count_like_sorted_coordinates(monkeypatch):
    monkeypatch.setattr(collocations, "TILE", 4)
    monkeypatch.setattr(collocations, "DENSE", 20)
    r = np.random.default_rng(3)
    left, right = r.zipf(1.5, 2000) % 19, r.zipf(1.5, 2000) % 19
    found = Counter()
    for (a, b), n in collocations.tiled(left, right, [left, right], lambda x, y: [x, y], 5):
        found.update(dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)))
    assert found == Counter(zip(left.tolist(), right.tolist(), strict=True))


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocations, "mixed", lambda columns: np.zeros(len(columns[0]), np.uint64))
    (a, b), n = collocations.grouped([np.array([1, 2, 1, 1]), np.array([5, 5, 5, 6])])
    assert sorted(zip(a.tolist(), b.tolist(), n.tolist(), strict=True)) == [(1, 5, 2), (1, 6, 1), (2, 5, 1)]


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    row = spark.createDataFrame([(big, big + 1, big + 7)], "n long, l long, r long").select(collocations._score("n", "l", "r")).first()
    assert row[0] == 1_000_000 * big * big // ((big + 1) * (big + 7))


def test_empty_table(spark, tmp_path):
    write(spark, [], "doc_id long, text string, lang string", tmp_path, "documents")
    assert queries.op11_collocations(spark, str(tmp_path)).collect() == []
