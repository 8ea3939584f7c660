"""Language of web pages by Bayesian fusion of evidence.

log posterior(l) = text likelihood(l) + log P(declared | l) + log P(suffix | l) + log P(l | host)

* Text: byte trigrams of the page's visible lower-case words, hashed into 2^15 places, with add-half smoothed
  frequencies per language learned from all documents that name a language. Neighbouring trigrams
  repeat each other, so a third of them counts, and at most `most_grams` in all.
* Declared language (the `lang` of the markup) and address suffix (last label of the host): how often each
  value stands with each language, counted over all pages with the text's posterior as weights and
  smoothed by the value's share of all pages.
* Host prior: the same weights summed per host, drawn towards the registered domain (last two labels),
  which is drawn towards all pages. A page's own weight is taken out of its host's sum.

Tables of values, hosts and domains come from grouped aggregation and meet the pages in joins; only
the trigram table (languages times 2^15 numbers, at most `MOST_LANGUAGES` languages) is sent to the tasks.

Defined results: missing declared language or host gives no evidence of that kind; a page without text
rests on the others; equal posteriors go to the language first in the alphabet; without documents that name a language
there are no languages, and language and posterior are null.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cyclelake.llm.common import map_rows, sliced, stored, texts, words

PLACES = 1 << 15
MOST_LANGUAGES = 256
# --- fixed values: markup whose content is not the page's text ------------------------------------
HIDDEN = {"script", "style", "nav", "footer", "aside", "noscript", "template", "head"}
# ---------------------------------------------------------------------------------------------------
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.IGNORECASE)
NAME = re.compile(r"/?\s*([A-Za-z][A-Za-z0-9]*)")


def visible(markup: str) -> str:
    """Text outside tags, comments and hidden elements, in one pass."""
    out, hidden, comment = [], "", False
    first, *parts = markup.split("<")
    out.append(first)
    for part in parts:
        if comment:
            comment = "-->" not in part
            tail = "" if comment else part.partition("-->")[2]
        elif part.startswith("!--"):
            comment = "-->" not in part
            tail = "" if comment else part.partition("-->")[2]
        else:
            tag, _, tail = part.partition(">")
            name = NAME.match(tag)
            word = name.group(1).lower() if name else ""
            if hidden:
                hidden = "" if tag.startswith("/") and word == hidden else hidden
                tail = "" if hidden else tail
            elif word in HIDDEN and not tag.startswith("/") and not tag.endswith("/"):
                hidden, tail = word, ""
        if not hidden and tail:
            out.append(tail)
    return html.unescape(" ".join(out))


def places(text: str) -> np.ndarray:
    """Place of every byte trigram of the words, with one space around each."""
    a = np.frombuffer(b" " + b" ".join(words(text)) + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.empty(0, np.int64)
    mixed = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77)) ^ (a[2:] * np.uint32(0xC2B2AE3D))
    return ((mixed ^ (mixed >> np.uint32(15))) & np.uint32(PLACES - 1)).astype(np.int64)


def fit(docs: DataFrame, language: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and the log frequencies of their trigram places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}  # one row of places per language
        for batch in sliced(batches):
            for one, name in zip(texts(batch, "__text"), batch.column("__language").to_pylist(), strict=True):
                if name not in held:
                    held[name] = np.zeros(PLACES, np.int64)
                held[name] += np.bincount(places(one), minlength=PLACES)
        for name, n in held.items():
            at = np.nonzero(n)[0]
            columns = [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])]
            yield pa.RecordBatch.from_arrays(columns, ["language", "place", "n"])

    named = docs.where(F.col(language).isNotNull()).select(F.col(text).alias("__text"), F.col(language).alias("__language"))
    counts = named.mapInArrow(run, "language string, place int, n long").groupBy("language", "place").agg(F.sum("n").alias("n"))
    counted = stored(counts)
    languages = sorted(r.language for r in counted.select("language").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = counted.toArrow()
    n = np.full((len(languages), PLACES), 0.5)
    at = {name: i for i, name in enumerate(languages)}
    n[[at[x] for x in table.column("language").to_pylist()], table.column("place").to_numpy()] += table.column("n").to_numpy()
    return languages, np.log(n / n.sum(axis=1, keepdims=True))


def read_pages(pages: DataFrame, logs: np.ndarray, key: str = "page_id", url: str = "url", markup: str = "html", most_grams: int = 200) -> DataFrame:
    """Stored evidence of every page: key, host, domain, suffix, declared, text (log likelihood per language)."""
    kind = pages.schema[key].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast(logs)

    def host_of(address: str | None) -> str | None:
        try:
            return (urlsplit(address or "").hostname or "").strip(".") or None
        except ValueError:
            return None

    def run(batch: pa.RecordBatch) -> dict:
        table = shared.value
        likelihoods, declared = [], []
        for one in texts(batch, markup):
            at = places(visible(one))
            scale = min(len(at) / 3, most_grams) / max(1, len(at))
            likelihoods.append((table[:, at].sum(axis=1) * scale).tolist())
            found = DECLARED.search(one)
            declared.append(found.group(1).lower() if found else None)
        hosts = [host_of(u) for u in batch.column(url).to_pylist()]
        return {
            key: batch.column(key), "host": hosts, "domain": [h and ".".join(h.split(".")[-2:]) for h in hosts],
            "suffix": [h and h.rsplit(".", 1)[-1] for h in hosts], "declared": declared, "text": likelihoods,
        }

    return stored(map_rows(pages.select(key, url, markup), run, f"`{key}` {kind}, host string, domain string, suffix string, declared string, text array<double>"))


def _softmax(values: Column) -> Column:
    raised = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    return F.transform(raised, lambda v: v / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _sums(evidence: DataFrame, by: list[str], name: str, size: int) -> DataFrame:
    """Rows and posterior weights per group."""
    summed = [F.sum(F.col("weight")[i]).alias(f"w{i}") for i in range(size)]
    total = evidence.groupBy(*by).agg(F.count("*").alias(f"{name}_n"), *summed)
    return total.select(*by, f"{name}_n", F.array(*[F.coalesce(f"w{i}", F.lit(0.0)) for i in range(size)]).alias(name))


def fuse(evidence: DataFrame, languages: list[str], key: str = "page_id", strength: float = 5.0) -> DataFrame:
    """Key, language, posterior, all posteriors, and the evidence of every page."""
    size = len(languages)
    if not size:
        empty = [F.lit(None).cast(t).alias(n) for n, t in (("language", "string"), ("posterior", "double"), ("posteriors", "map<string,double>"), ("text_language", "string"))]
        return evidence.select(key, *empty, "declared", "suffix", "host")
    weighed = evidence.withColumn("weight", _softmax(F.col("text")))
    all_n, overall = _sums(weighed, [], "all", size).first()
    prior = F.array(*[F.lit((w + 1 / size) / (all_n + 1)) for w in overall])
    mass = F.array(*[F.lit(w + strength) for w in overall])

    def given(column: str) -> DataFrame:
        """log P(value | language) of every value of a column."""
        found = _sums(weighed.where(F.col(column).isNotNull()), [column], "with", size)
        share = F.col("with_n") / F.lit(float(max(1, all_n)))
        return found.select(column, F.transform(F.arrays_zip(F.col("with").alias("w"), mass.alias("m")), lambda x: F.log((x.w + strength * share) / x.m)).alias(f"by_{column}"))

    def drawn(own: Column, n: Column, towards: Column) -> Column:
        return F.transform(F.arrays_zip(own.alias("o"), towards.alias("t")), lambda x: (x.o + strength * x.t) / (n + strength))

    placed = weighed.where(F.col("host").isNotNull())
    domains = _sums(placed, ["domain"], "domain_w", size).select("domain", drawn(F.col("domain_w"), F.col("domain_w_n"), prior).alias("domain_prior"))
    hosts = _sums(placed, ["host", "domain"], "host_w", size).join(domains, "domain").drop("domain")
    own = F.transform(F.arrays_zip(F.col("host_w").alias("h"), F.col("weight").alias("w")), lambda x: F.greatest(x.h - x.w, F.lit(0.0)))
    host_prior = F.when(F.col("host_w").isNotNull(), drawn(own, F.col("host_w_n") - 1, F.col("domain_prior"))).otherwise(prior)
    none = F.array(*[F.lit(0.0)] * size)
    met = weighed.join(hosts, "host", "left").join(given("declared"), "declared", "left").join(given("suffix"), "suffix", "left")
    parts = F.arrays_zip(
        F.col("text").alias("t"), F.coalesce("by_declared", none).alias("d"), F.coalesce("by_suffix", none).alias("s"), host_prior.alias("h")
    )
    posterior = met.withColumn("p", _softmax(F.transform(parts, lambda x: x.t + x.d + x.s + F.log(x.h))))
    names = F.array(*map(F.lit, languages))
    best = lambda values: names[(F.array_position(values, F.array_max(values)) - 1).cast("int")]
    return posterior.select(
        key, best(F.col("p")).alias("language"), F.array_max("p").alias("posterior"), F.map_from_arrays(names, "p").alias("posteriors"),
        best(F.col("text")).alias("text_language"), "declared", "suffix", "host",
    )
