import random
from collections import Counter

from tables import awkward_texts, documents, prose
from test_simhash import groups, plain_fingerprint

import corpus_pipeline


def plain_shingles(text):
    w = tuple((text or "").encode().lower().split())
    return frozenset(w[i : i + 5] for i in range(max(1, len(w) - 4)))


def changed(text, places, seed):
    r, w = random.Random(seed), text.split()
    for at in r.sample(range(len(w)), places):
        w[at] = f"new{seed}x{at}"
    return " ".join(w)


def test_near_copies_of_similarity_four_fifths_leave_one(spark, tmp_path):
    texts = [changed(prose(i // 6, 150), i % 6, i) for i in range(120)] + awkward_texts()
    rows = documents(spark, texts, tmp_path)
    sets = sorted({plain_shingles(r[1]) for r in rows}, key=sorted)
    pairs = [(i, j) for i, a in enumerate(sets) for j in range(i + 1, len(sets)) if 5 * len(a & sets[j]) >= 4 * len(a | sets[j])]
    prints = {plain_shingles(r[1]): plain_fingerprint(r[1]) for r in rows}
    assert any((prints[sets[i]] ^ prints[sets[j]]).bit_count() > 3 for i, j in pairs)
    root = groups(range(len(sets)), pairs)
    number = {s: root[i] for i, s in enumerate(sets)}
    first = {}
    for r in rows:
        at = number[plain_shingles(r[1])]
        first[at] = min(first.get(at, (True, 0)), (r[0] is None, r[0] or 0))
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == Counter(first.values())


def test_columns_of_any_name_stay(spark, tmp_path):
    texts = [prose(i // 2, 60) for i in range(20)]
    names = ["__hash", "__score", "__text", "__key", "hash", "more", "score", "id", "gram", "least", "own", "n", "n_tokens", "decoded", "a b"]
    rows = [(i, t, None, "s", 1, *range(i, i + len(names))) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in names)
    docs = spark.createDataFrame(rows + rows[:3], schema).repartition(4)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [r for r in rows if r[0] % 2 == 0]
    spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scored = corpus_pipeline.keep_quality(spark, kept, str(tmp_path))
    assert scored.columns == docs.columns and scored.count() <= 10
    coded = corpus_pipeline.encode_tokens(spark, kept, str(tmp_path))
    assert sorted(coded.columns) == sorted({*docs.columns, "ids"}) and coded.where("n_tokens > 20").count() == 10


def test_lists_of_several_components_are_compared(spark):
    """A frequent shingle list whose smallest text is far from the others, which are near each other."""
    shared = prose(900, 40).split()
    texts = [" ".join([*shared[:8], *prose(i, 30).split()]) for i in range(40)]
    near = [" ".join([*shared[:8], *changed(prose(77, 120), 1, k).split()]) for k in range(6)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + near)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    sets = [plain_shingles(t) for t in texts + near]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = groups(range(len(sets)), pairs)
    assert kept == {min(i for i in root if root[i] == r) for r in set(root.values())} and len(pairs) > 3


def test_simhash_segments_give_the_first_candidates(spark):
    """Pairs within three bits come from op4's grid, and what it gives is verified like all others."""
    from cyclelake.llm import jaccard, simhash

    texts = [changed(prose(i // 4, 400), i % 4, i) for i in range(40)]
    calls, original = [], simhash.links
    simhash.links = lambda distinct, distance=3: calls.append(distinct.count()) or original(distinct, distance)
    try:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    finally:
        simhash.links = original
    assert kept == set(range(0, 40, 4)) and len(calls) == 1 and calls[0] > 10
    rows = [(i, simhash.fingerprint(t, 5)) for i, t in enumerate(texts)]
    prints = spark.createDataFrame(rows, "id long, fingerprint long")
    found = {(r.a, r.b) for r in jaccard.fingerprint_pairs(prints).collect()}
    lead = {f: min(i for i, g in rows if g == f) for _, f in rows}
    near = {tuple(sorted((lead[f], lead[g]))) for f in lead for g in lead if f != g and ((f ^ g) & (1 << 64) - 1).bit_count() <= 3}
    assert found == near | {(lead[f], i) for i, f in rows if lead[f] != i} and near


def test_pairs_across_components_are_made_once(spark, monkeypatch):
    """Near copies of one text that few links join at first: another star leaves few pairs, each made once for all shared lists."""
    from cyclelake.llm import jaccard

    r = random.Random(5)
    texts = [changed(prose(5, 200), r.randrange(2, 5), i) for i in range(150)]
    made, original = [], jaccard.verified
    monkeypatch.setattr(jaccard, "fingerprint_pairs", lambda prints: prints.select(prints.id.alias("a"), prints.id.alias("b")).limit(0))
    monkeypatch.setattr(jaccard, "verified", lambda pairs, read: made.append((pairs.count(), pairs.distinct().count())) or original(pairs, read))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    sets = [plain_shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = groups(range(len(sets)), pairs)
    assert kept == {min(i for i in root if root[i] == r) for r in set(root.values())} and len(pairs) > 500
    assert all(n == m for n, m in made) and made[-1][0] < len(pairs) and len(made) > 3
