"""Small tables with awkward rows, written as the queries read them."""

import random
import zlib

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
RUDE = ["idiot", "moron", "clown"]

# Columns with names that the operators use inside.
EXTRA = "score double, row long, fingerprint long, component_id long, word string, n long, part int, place long, base string, terms string, ids string, root long, end int"
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.choice([1, 1, 2, 3]))) for _ in range(n))


def awkward_texts() -> list[str | None]:
    """Null, empty, blank, one word, marks, other scripts, line ends, a very long word and a very long text."""
    return [
        None, "", " \t\n", "Word", "!!! ... ---", "naïve CAFÉ Straße ΣΑΣ ١٢", "a\x0bb\x1cc\x85d\xa0e　f", "퟿\U0001f600 emoji",
        "x" * 20_000, prose(99, 30_000), "the the the the the the", "A B", "a b", "<|endoftext|> special <|startoftext|>",
    ]


def documents(spark, texts, path, langs=("en", "fr", None)):
    rows = [(i, t, langs[i % len(langs)], f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[-1], rows[-1], (None, "no key here", "en", None, 11), (None, None, None, None, None)]
    extra = (1.0, 2, 3, 4, "w", 5, 6, 7, "b", "t", "i", 8, 9)
    write(spark, [r + extra for r in rows], DOCUMENTS, path, "documents")
    return rows


def write(spark, rows, schema, path, name):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")


def crc(value) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode())
