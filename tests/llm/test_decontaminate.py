import random
from collections import Counter

from tables import awkward_texts, documents, prose, write

from cyclelake.llm import decontaminate, queries

ITEMS = "item_id long, text string, budget int"


def distance(item, text):
    """Smallest edit distance of the item to any substring."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edited(text, edits, r):
    out = list(text)
    for _ in range(edits):
        at = r.randrange(len(out))
        kind = r.randrange(3)
        if kind == 0:
            out[at] = r.choice("xyz")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, r.choice("xyz"))
    return "".join(out)


def test_distance_equals_the_table():
    r = random.Random(3)
    for _ in range(500):
        item = "".join(r.choice("abc ") for _ in range(r.randint(1, 20)))
        text = "".join(r.choice("abc ") for _ in range(r.randint(0, 40)))
        best, end = decontaminate.Pattern(item).best(text, 0, len(text))
        assert best == distance(item, text)
        assert best == len(item) or any(distance(item, text[a:end]) == best for a in range(end + 1))


def test_query_equals_all_distances(spark, tmp_path):
    r = random.Random(7)
    items = [(i, prose(1000 + i, 14).capitalize() + ".", 1) for i in range(12)] + [(12, "Two words", 1), (13, "", 1), (14, None, 1), (None, prose(77, 20), 1), (0, prose(1000, 14), 1)]
    texts = []
    for i in range(60):
        own = prose(i, 30).split()
        source = items[i % 12][1]
        own[r.randrange(30) : 0] = [edited(source, i % 8, r)] if i % 2 else []
        texts.append(" ".join(own))
    texts += [items[3][1].upper().replace(" ", "!!\n"), "only two words here", "two wordsmith", prose(77, 20)] + awkward_texts()[:8]
    rows = documents(spark, texts, tmp_path)
    write(spark, items, ITEMS, tmp_path, "benchmark")
    expected = Counter()
    for key, text, *_ in rows:
        plain = decontaminate.plain(text)
        for item, raw, _ in items:
            form = decontaminate.plain(raw)
            if not form or not plain:
                continue
            if len(form) < decontaminate.EXACT_BELOW:
                if f" {form} " in f" {plain} ":
                    expected[(key, item, 0)] += 1
            elif (d := distance(form, plain)) <= int(decontaminate.RATE * len(form)):
                expected[(key, item, d)] += 1
    assert len(expected) > 15 and any(d for _, _, d in expected)
    found = queries.op10_edit_matches(spark, str(tmp_path))
    assert Counter((r.doc_id, r.item_id, r.distance) for r in found.collect()) == expected
    docs, benchmark = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))
    blocks = decontaminate.leaks(docs, benchmark, block_chars=100)
    assert Counter((r.doc_id, r.item_id, r.distance) for r in blocks.collect()) == expected
    clean = decontaminate.without_leaks(docs, benchmark, block_chars=100)
    assert clean.columns == docs.columns
    dirty = {k for k, _, _ in expected}
    assert Counter(r.doc_id for r in clean.collect()) == Counter(k for k, *_ in rows if k not in dirty)


def test_empty_tables(spark, tmp_path):
    write(spark, [], "doc_id long, text string", tmp_path, "documents")
    write(spark, [], ITEMS, tmp_path, "benchmark")
    assert queries.op10_edit_matches(spark, str(tmp_path)).collect() == []
    documents(spark, ["some text"], tmp_path / "other")
    write(spark, [], ITEMS, tmp_path / "other", "benchmark")
    assert queries.op10_edit_matches(spark, str(tmp_path / "other")).collect() == []
