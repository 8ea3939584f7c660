import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tables import DOCUMENTS, awkward_texts, documents, prose, write
from test_jaccard import plain_shingles
from test_pii import plain_base, private
from test_simhash import groups
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline

from cyclelake.llm import decontaminate


def junk(text):
    return " ".join(w + "***" for w in text.split())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    items = [(i, prose(5000 + i, 25)) for i in range(4)]
    texts = [junk(prose(i, 80)) if i % 3 == 0 else prose(i, 80) for i in range(120)]
    texts += [prose(i, 80) for i in range(1, 60, 3)]  # copies of good texts
    texts += [prose(300 + i, 30) + " " + items[i][1] + " " + prose(400 + i, 30) for i in range(4)]
    texts += [private(i) for i in range(500, 560)] + awkward_texts()
    rows = documents(spark, texts, path)
    labels = [(k, int("***" not in (t or "")), 0) for k, t, *_ in rows if k is not None and k < 120]
    write(spark, labels, "doc_id long, quality int, toxic int", path, "labels")
    write(spark, items, "item_id long, text string", path, "benchmark")
    return str(path)


def test_every_stage_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, made = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        made[name] = (before.collect(), docs.collect())
        if name != "bpe":
            assert docs.columns == columns

    before, after = made["quality"]
    assert {r.doc_id for r in before if "***" in (r.text or "")} == {i for i in range(0, 120, 3)}
    assert Counter(r.doc_id for r in after if (r.doc_id or 0) < 120 and r.doc_id is not None) == Counter([i for i in range(120) if i % 3] + [])
    assert {i for i in range(120, 204)} <= {r.doc_id for r in after}

    before, after = made["near_duplicates"]
    sets = sorted({plain_shingles(r.text) for r in before}, key=sorted)
    number = {s: i for i, s in enumerate(sets)}
    root = groups(range(len(sets)), [(i, j) for i, a in enumerate(sets) for j in range(i + 1, len(sets)) if 5 * len(a & sets[j]) >= 4 * len(a | sets[j])])
    assert Counter(root[number[plain_shingles(r.text)]] for r in after) == Counter(set(root.values()))

    before, after = made["decontamination"]
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    dirty = [r.doc_id for r in before if any(i in decontaminate.plain(r.text) for i in items)]
    assert len(dirty) == 4 and Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before) - Counter(dirty)

    before, after = made["personal_data"]
    assert sum(bool(plain_base(r.text or "")) for r in before) > 50 and not any(plain_base(r.text or "") for r in after)
    assert all(r.n_chars == len(r.text) for r in after if r.text is not None)
    same = {r.doc_id: r.text for r in before if not plain_base(r.text or "")}
    assert all(same[r.doc_id] == r.text for r in after if r.doc_id in same and r.doc_id is not None)

    before, after = made["bpe"]
    reference = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    reference.no_truncation()
    expected = Counter((r.doc_id, tuple(reference.encode(r.text or "", add_special_tokens=False).ids)) for r in before)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in after) == expected

    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == Counter(r.doc_id for r in after)


def test_empty_tables(spark, tmp_path):
    write(spark, [], DOCUMENTS, tmp_path, "documents")
    write(spark, [], "doc_id long, quality int, toxic int", tmp_path, "labels")
    write(spark, [], "item_id long, text string", tmp_path, "benchmark")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
