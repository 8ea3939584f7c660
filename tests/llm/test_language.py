import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from tables import awkward_texts, documents, write

from cyclelake.llm import language, queries

ENGLISH = "the house of the man that was in the water with this and those words that they have"
FRENCH = "la maison de la femme qui est dans une eau avec cette chose et les mots des gens"
PAGES = "page_id long, url string, html string, text string, host string, weight double"


def page(i, text, declared, host):
    lang = f' lang="{declared}"' if declared else ""
    markup = f"<!doctype html><html{lang}><head><title>x</title></head><body><nav>nav words here</nav><!-- c <p>no</p> --><p>{text}</p><script>var a='<p>z';</script></body></html>"
    return (i, f"https://{host}/p/{i}?q=1" if host else None, markup, "t", "h", 1.0)


def fixture():
    pages = [page(i, ENGLISH if i % 3 else FRENCH, "en" if i % 3 else "fr-FR", f"h{i % 4}.example.{'fr' if i % 3 == 0 else 'com'}") for i in range(60)]
    pages += [page(60, "", "fr", "h0.example.fr"), page(61, FRENCH, "en", "h1.example.com"), page(62, ENGLISH, None, None), (63, None, None, None, None, None)]
    pages += [(64, "http://[bad", "<p>" + ENGLISH, None, None, None), (None, "x", "<script>" * 3000, None, None, None), pages[0], pages[0]]
    return pages


def test_query_equals_plain_bayes(spark, tmp_path):
    documents(spark, [ENGLISH, FRENCH, None] * 10 + awkward_texts()[:1], tmp_path)
    pages = fixture()
    write(spark, pages, PAGES, tmp_path, "pages")
    languages, logs = language.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert languages == ["en", "fr"]
    evidence = [r.asDict() for r in language.read_pages(spark.read.parquet(f"{tmp_path}/pages.parquet"), logs).collect()]
    soft = lambda v: np.exp(np.array(v) - max(v)) / np.exp(np.array(v) - max(v)).sum()
    strength, size = 5.0, 2
    by = {c: defaultdict(lambda: [0, np.zeros(size)]) for c in ("declared", "suffix", "host", "domain")}
    total, n = np.zeros(size), 0
    for e in evidence:
        e["w"] = soft(e["text"])
        total, n = total + e["w"], n + 1
        for c in by:
            if e[c] is not None:
                by[c][e[c]][0] += 1
                by[c][e[c]][1] += e["w"]
    prior = (total + 1 / size) / (n + 1)
    expected = Counter()
    for e in evidence:
        logp = np.array(e["text"])
        for c in ("declared", "suffix"):
            if e[c] is not None:
                k, w = by[c][e[c]]
                logp = logp + np.log((w + strength * k / n) / (total + strength))
        if e["host"] is None:
            logp = logp + np.log(prior)
        else:
            k, w = by["domain"][e["domain"]]
            domain = (w + strength * prior) / (k + strength)
            k, w = by["host"][e["host"]]
            logp = logp + np.log((np.maximum(w - e["w"], 0) + strength * domain) / (k - 1 + strength))
        p = soft(logp)
        expected[(e["page_id"], languages[int(p.argmax())], round(float(p.max()), 6))] += 1
    found = queries.op8_language_evidence(spark, str(tmp_path)).collect()
    assert Counter((r.page_id, r.language, round(r.posterior, 6)) for r in found) == expected
    said = {r.page_id: r.language for r in found}
    assert said[60] == "fr" and said[61] == "fr" and said[62] == "en" and said[64] == "en"
    assert all(said[i] == ("en" if i % 3 else "fr") for i in range(60))
    assert math.isclose(sum(found[0].posteriors.values()), 1)


def test_visible_text():
    markup = "a<b>c</b><!-- <p>no --> d<script>if(a<b)</script>e&amp;f<style/>g<nav>h<p>i</nav>j"
    assert language.visible(markup).split() == ["a", "c", "d", "e&f", "g", "j"]


@pytest.mark.parametrize("named", [[], [(1, "x y", None)]])
def test_without_languages(spark, tmp_path, named):
    write(spark, named, "doc_id long, text string, lang string", tmp_path, "documents")
    write(spark, fixture()[:3], PAGES, tmp_path, "pages")
    assert {(r.language, r.posterior) for r in queries.op8_language_evidence(spark, str(tmp_path)).collect()} == {(None, None)}


def test_empty_pages(spark, tmp_path):
    documents(spark, [ENGLISH, FRENCH], tmp_path)
    write(spark, [], PAGES, tmp_path, "pages")
    assert queries.op8_language_evidence(spark, str(tmp_path)).collect() == []
