import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
from tables import awkward_texts, documents, prose, write
from tokenizers import Tokenizer

from cyclelake.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


def test_random_texts_equal_the_library():
    r, reference = random.Random(1), library()
    letters = "aAbBéÉ'sS’tTΣσςİıßÄ 0१²½Ⅷ\t\n\x0b\r\x1c\x1f\x85\xa0 　​_-!!??。中文ภาษา😀é\x00ǅ<|startoftext|>"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["", "<|startoftext|>a<|endoftext|>B", "'S'LL don't we'RE", "the" * 3000, "-" * 5000, "<|endoftext|"]
    for text, (ids, n, decoded) in zip(texts, bpe.encode_batch(bpe.vocabulary_at(PATH), texts), strict=True):
        expected = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected and n == len(expected), text
        assert decoded == reference.decode(expected, skip_special_tokens=False)


def test_query_equals_the_library_and_decodes(spark, tmp_path):
    rows, reference = documents(spark, [prose(i, 50) for i in range(30)] + awkward_texts(), tmp_path), library()
    expected = Counter()
    for key, text, *_ in rows:
        ids = reference.encode(text or "", add_special_tokens=False).ids
        decoded = reference.decode(ids, skip_special_tokens=False)
        expected[(key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += 1
    assert Counter(map(tuple, queries.op7_bpe(spark, str(tmp_path)).collect())) == expected
    coded = bpe.encode(spark.read.parquet(f"{tmp_path}/documents.parquet"), PATH)
    back = bpe.decode(coded, PATH)
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, coded.select("doc_id", "decoded").collect()))


def test_the_cache_changes_nothing(monkeypatch):
    texts = [prose(i, 40) for i in range(20)]
    whole = bpe.encode_batch(bpe.Vocabulary(PATH), texts)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    monkeypatch.setattr(bpe, "BLOCK_SYMBOLS", 64)
    small = bpe.Vocabulary(PATH)
    assert [bpe.encode_batch(small, [t])[0] for t in texts] == whole


def test_empty_table(spark, tmp_path):
    write(spark, [], "doc_id long, text string", tmp_path, "documents")
    assert queries.op7_bpe(spark, str(tmp_path)).collect() == []
