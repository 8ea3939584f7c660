import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tables import awkward_texts, crc, documents, prose, write

from cyclelake.llm import queries, suffix_tree
from cyclelake.llm.common import fold


def tokens(text):
    return (text or "").encode().lower().split()


def plain_tree(texts, limits):
    """Kept contexts and smoothed distributions with dictionaries."""
    counts, depth = {}, limits.depth
    for text in texts:
        s = b"\n" * depth + b" ".join(tokens(text)) + b"\n"
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                counts.setdefault(s[i - d : i], Counter())[s[i]] += 1
    total = sum(counts.get(b"", Counter()).values())
    kept = {b""}
    for context, own in counts.items():
        if context and (n := sum(own.values())) >= max(2.0, limits.least_share * total):
            parent = counts[context[1:]]
            gain = sum(c * math.log((c / n) / (parent[a] / sum(parent.values()))) for a, c in own.items())
            if gain >= limits.least_gain:
                kept.add(context)

    def p(context, symbol):
        while context not in kept:
            context = context[1:]
        own = counts.get(context, Counter())
        below = p(context[1:], symbol) if context else 1 / 256
        n, kinds = sum(own.values()), len(own)
        return (own[symbol] + kinds * below) / (n + kinds) if n else below

    def score(text):
        s = b"\n" * depth + b" ".join(tokens(text)) + b"\n"
        return sum(math.log10(p(s[i - depth : i], s[i])) for i in range(depth, len(s)))

    return score, kept


def test_query_equals_plain_counts_and_tree(spark, tmp_path):
    texts = [prose(i, 60) for i in range(60)] + awkward_texts()
    rows = documents(spark, texts, tmp_path)
    found = queries.op1_suffix_tree(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    train = [r[1] for r in rows if crc(r[0]) % 10]
    score, kept = plain_tree(train, suffix_tree.Limits())
    assert len(kept) > 20
    c = Counter(w for t in train for w in tokens(t)) + Counter({None: len(train)})
    total, distinct = sum(c.values()), len(c)
    expected = Counter()
    for key, text, *_ in rows:
        own = [*tokens(text), None]
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        expected[(key, crc(key) % 10 == 0, len(own), sum(c[w] > 0 for w in own), total, round(base, 4), round(score(text), 4))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in found) == expected


def test_unseen_texts_are_scored_better_than_by_words_alone(spark):
    held = [r for r in queries.op1_suffix_tree(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(held) > 50
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_table(spark, tmp_path):
    write(spark, [], "doc_id long, text string", tmp_path, "documents")
    assert queries.op1_suffix_tree(spark, str(tmp_path)).collect() == []


def test_without_training_texts_all_bytes_are_equal(spark, tmp_path):
    write(spark, [(next(i for i in range(100) if crc(i) % 10 == 0), "Ab c")], "doc_id long, text string", tmp_path, "documents")
    row = queries.op1_suffix_tree(spark, str(tmp_path)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert row.score == pytest.approx(5 * math.log10(1 / 256))


def test_rarer_contexts_count_too(spark, tmp_path):
    """Contexts below the share that is sent to the tasks: the tree and its scores stay whole."""
    texts = [prose(i, 60) for i in range(60)] + awkward_texts()
    rows = documents(spark, texts, tmp_path)
    train = [r[1] for r in rows if crc(r[0]) % 10]
    plain, kept = plain_tree(train, suffix_tree.Limits(least_share=0.0))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for share in (0.0005, 0.02, 1.0):
        model = suffix_tree.fit(docs, fold(F.col("doc_id"), 10) != 0, limits=suffix_tree.Limits(least_share=share))
        sent = len(model.kept.where("hot").select("length", "context").distinct().collect())
        assert sent < len(kept) == len(model.kept.select("length", "context").distinct().collect()) and model.rare is not None
        found = suffix_tree.score(docs, model, ["doc_id"]).collect()
        assert Counter((r.doc_id, round(r.score, 4)) for r in found) == Counter((r[0], round(plain(r[1]), 4)) for r in rows)
