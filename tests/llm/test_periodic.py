import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tables import awkward_texts, crc, documents, prose, write

from cyclelake.llm import periodic, queries


def runs_of(words):
    """(start, stop, smallest period) of all runs, by comparing each word with the one a period later."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        start = None
        for i in range(n - q + 1):
            if i < n - q and words[i] == words[i + q]:
                start = i if start is None else start
            elif start is not None:
                if i - start >= q and i + q - start >= 12:
                    found.setdefault((start, i + q), q)
                start = None
    return sorted((a, b, q) for (a, b), q in found.items())


def words_of(key, text):
    words, h = (text or "").encode().split(), crc(key)
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def brute(key, text):
    words = words_of(key, text)
    runs = sorted(runs_of(words), key=lambda r: (r[0], r[2]))
    dropped = {i for a, b, q in runs for i in range(a + q, b)}
    best = min(((a - b, a, q) for a, b, q in runs), default=None)
    longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (key, len(runs), *longest, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


def solved(ids):
    """Runs of one text from its tiles, stitched in plain Python."""
    parts = {}
    for low, high, start, own in periodic.tile_rows(ids):
        for q, a, b in periodic.fragments(own, low, high):
            parts.setdefault(q, []).append((start + a, start + b))
    out = []
    for q, found in parts.items():
        for a, b in sorted(found):
            if out and out[-1][2] == q and a <= out[-1][1] - q:
                out[-1] = (out[-1][0], max(b, out[-1][1]), q)
            else:
                out.append((a, b, q))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_tiles_find_all_runs(seed):
    r = random.Random(seed)
    for _ in range(300):
        n, kinds = r.choice([5, 12, 13, 30, 60, 100, 200, 400]), r.choice([1, 2, 3, 5, 50, 1000])
        ids = [r.randrange(kinds) for _ in range(n)]
        for _ in range(r.randrange(4)):
            a = r.randrange(n)
            q = 1 + r.randrange(max(1, (n - a) // 2))
            for i in range(a + q, min(n, a + int(q * r.uniform(1.5, 8)))):
                ids[i] = ids[i - q]
        assert solved(np.array(ids, np.int32)) == runs_of(ids)


def test_query_equals_brute_force(spark, tmp_path):
    made = [prose(i, 40 + 17 * i) for i in range(60)] + ["a b c " * 7, "x " * 300, "a b " * 6 + "c " + "b a " * 6, ("p q r s t u v w y z " * 3 + "! ") * 5]
    rows = documents(spark, [t if t is None or len(t) < 50_000 else t[:6_000] for t in made + awkward_texts()], tmp_path)
    found = queries.op12_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = Counter(tuple(r) for r in found.select(*names).collect())
    assert got == Counter(brute(r[0], r[1]) for r in rows)
    assert sum(n for r, n in got.items() if r[1]) >= 8


def test_a_long_text_of_few_runs(spark):
    words = prose(5, 30_000).split()
    words[4_000:20_000] = words[4_000:8_000] * 4
    words[25_000:25_400] = ["same"] * 400
    docs = spark.createDataFrame([(1, " ".join(words), 5)], "doc_id long, text string, text_row long")
    row = periodic.summary(docs).first()
    assert [tuple(map(int, line.split(","))) for line in row.runs.splitlines()] == [(4_000, 16_000, 4_000), (25_000, 400, 1)]
    assert row.collapsed_sha256 == hashlib.sha256(" ".join(words[:8_000] + words[20_000:25_001] + words[25_400:]).encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    write(spark, [], "doc_id long, text string", tmp_path, "documents")
    assert queries.op12_periodic_runs(spark, str(tmp_path)).collect() == []
