import hashlib
import random
from collections import Counter

import pytest
from tables import awkward_texts, documents, prose, write

from cyclelake.llm import queries, repeats


def brute(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def passages():
    r = random.Random(3)
    source = "".join(r.choice("abcdefgh é") for _ in range(5_000))
    made = [source, source[:399], source[:400], source[100:600], source[100:499], source[99:500], "z" + source[3000:3400] + "y"]
    made += [source[2000:2700] + "Q" + source[2701:4000], "x" * 1500, "ab" * 700, prose(1, 300), prose(1, 300)]
    made += [prose(i, 40) + " " + source[(a := r.randrange(4_000)) :][: r.randrange(300, 900)] for i in range(40)]
    return made + [f"{i} {source[1000:1500]} {i}" for i in range(30)] + [source[3000:3400]]


def test_query_equals_brute_force(spark, tmp_path):
    rows = documents(spark, passages() + [t if t is None or len(t) < 50_000 else t[:9_000] for t in awkward_texts()], tmp_path)
    found = Counter(tuple(r)[:5] for r in queries.op13_repeated_bytes(spark, str(tmp_path)).collect())
    assert found == Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], 400), strict=True))


@pytest.mark.parametrize(("threshold", "gram"), [(8, 3), (21, 20), (40, 13), (60, 1)])
def test_other_lengths(spark, threshold, gram):
    r = random.Random(threshold)
    texts = ["".join(r.choice("ab" if i % 2 else "abcdefghij") for _ in range(r.randrange(200))) for i in range(60)]
    texts += [t[5:90] + "#" + t[20:] for t in texts[:30]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, core string").repartition(3)
    found = repeats.without_repeats(docs, threshold=threshold, gram=gram, texts=True).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found] == brute(texts, threshold)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)


def test_long_texts_are_read_in_chunks(monkeypatch):
    data = random.Random(1).randbytes(5_000)
    whole = list(repeats.suffix_rows(data, 400, 200))
    monkeypatch.setattr(repeats, "CHUNK", 1_000)
    cut = list(repeats.suffix_rows(data, 400, 200))
    spread = lambda rows: [(s, place, core) for start, many, place, core in rows for s in range(start, start + many)]
    assert spread(cut) == spread(whole) and len(spread(whole)) == 4_601
    assert all(start <= place <= start + many + 199 and place <= s + 200 for start, many, place, _ in whole for s in (start,))


def test_cells_cover_a_row_and_share_a_core():
    for many in range(1, 40):
        for place in range(30):
            made = list(repeats.cells(many, place + many - 1, 7))
            assert [s for first, n, _, _ in made for s in range(first, first + n)] == list(range(many))
            assert all(begin >= first + n - 1 and stop <= first for first, n, begin, stop in made)


def test_empty_table(spark, tmp_path):
    write(spark, [], "doc_id long, text string", tmp_path, "documents")
    assert queries.op13_repeated_bytes(spark, str(tmp_path)).collect() == []
