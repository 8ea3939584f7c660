import random
from collections import Counter

import xxhash
from tables import awkward_texts, documents, prose, write

from cyclelake.llm import queries, simhash
from cyclelake.llm.components import components


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(max(find(a), find(b)))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_equal_all_pairs(spark):
    r = random.Random(4)
    values = {0, 1, 3, 7, 15, 2**64 - 1}
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 30)):
            y = x
            for _ in range(r.randint(0, 4)):
                y ^= 1 << r.randrange(64)
            values.add(y)
    values = sorted(values)
    expected = Counter(tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3)
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    assert Counter(tuple(sorted(r)) for r in simhash.links(nodes).collect()) == expected
    for distance in (0, 1, 2):
        few = Counter(tuple(sorted(r)) for r in simhash.links(nodes, distance).collect())
        assert few == Counter(p for p in expected if ((p[0] ^ p[1]) & (2**64 - 1)).bit_count() <= distance)


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (300, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    expected = groups({n for p in pairs if p[0] != p[1] for n in p}, pairs[:-1])
    assert found == expected


def test_query_equals_brute_force(spark, tmp_path):
    texts = [prose(i // 4, 120) + (f" tail{i % 4}" if i % 2 else "") for i in range(80)] + awkward_texts()
    rows = documents(spark, texts, tmp_path)
    prints = [plain_fingerprint(r[1]) for r in rows]
    pairs = [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 3]
    assert pairs
    root = groups(set(prints), pairs)
    smallest = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            smallest[root[p]] = min(smallest.get(root[p], r[0]), r[0])
    found = queries.op4_simhash_segments(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, found)) == Counter((r[0], f"{p:016x}", smallest.get(root[p])) for r, p in zip(rows, prints, strict=True))


def test_one_row_of_each_component_stays(spark, tmp_path):
    rows = documents(spark, [prose(i // 3, 90) for i in range(30)] + awkward_texts(), tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    prints = {p for p in map(plain_fingerprint, (r[1] for r in rows))}
    root = groups(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
    first = {}
    for r in rows:
        at = root[plain_fingerprint(r[1])]
        first[at] = min(first.get(at, (True, 0)), (r[0] is None, r[0] or 0))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == Counter(first.values())


def test_empty_table(spark, tmp_path):
    write(spark, [], "doc_id long, text string", tmp_path, "documents")
    assert queries.op4_simhash_segments(spark, str(tmp_path)).collect() == []
    assert simhash.one_per_component(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect() == []
