"""Collocations and ranked search against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from brute import lower
from pyspark.sql import functions as F

from custlens.llm import collocations, lexical

KINDS = "doc_id bigint, text string, lang string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ENDS = re.compile(r"[.,;:!?\x0A-\x0D]")


def frame(spark, rows):
    return spark.createDataFrame(rows, KINDS)


def best_phrases(rows, least, first):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in ENDS.split(lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 6):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, found in counts.items():
        f = {p: a for p, a in found.items() if a >= least}
        scored = []
        for p, a in f.items():
            if len(p) < 2:
                continue
            cuts = [(1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(
                len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in f.items()
            )
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def phrase_rows(seed=2):
    rng = np.random.default_rng(seed)
    vocabulary = np.array(["a", "b", "C", "der", "é1", "x'y", "na\x0eo", "zz", "日本", "k-9"])
    rows = []
    for i in range(120):
        words = rng.choice(vocabulary, rng.integers(0, 60), p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])
        ends = rng.choice([" ", "  ", "\t", ". ", ",", "\n", "!? "], len(words), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
        rows.append((i, "".join(w + e for w, e in zip(words, ends)), ["en", "de", None][i % 3]))
    passage = "the quick brown fox jumps over the lazy dog and runs far away from every hunter in the wood " * 3
    rows += [(200 + i, f"{rows[i][1]} {passage} tail{i}", "en") for i in range(20)]
    rows += [(300 + i, "na " * 700, "en") for i in range(2)] + [(310, passage * 40, "und"), (311, "na " * 700, "en")]
    return rows + [(400, None, "en"), (401, "", "de"), (402, " .,\t\n", "fr"), (403, "one", ""), (200, rows[0][1], "en")]


@pytest.mark.parametrize("least, first", [(20, 2000), (5, 7), (1, 50)])
def test_collocations(spark, least, first):
    rows = phrase_rows()
    docs = frame(spark, rows).withColumn("rank", F.lit("clash")).withColumn("phrase", F.lit(1)).repartition(5)
    got = collocations.collocations(docs, least=least, first=first)
    assert sorted(map(tuple, got.collect())) == best_phrases(rows, least, first)


def test_chunks_cover_every_phrase_once(spark):
    rows = phrase_rows(5)
    parsed = collocations.dictionary(frame(spark, rows)).collect()
    assert len({(r["lang"], r["chunk"], r["own"]) for r in parsed}) == len(parsed)
    want, got = Counter(), Counter()
    for _, text, lang in rows:
        for piece in ENDS.split(lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang or ("und" if lang is None else lang), tuple(w[i : i + 5])) for i in range(len(w)))
    for r in parsed:
        at = 0
        for piece in r["chunk"].split("\n"):
            w = piece.split(" ")
            for i in range(len(w)):
                if at < r["own"]:
                    got[r["lang"], tuple(w[i : i + 5])] += r["times"]
                at += 1
    assert got == want


def test_equal_passages_share_chunks(spark):
    passage = " ".join(f"p{i * i}" for i in range(2000))
    rows = [(i, " ".join(f"d{i}x{j}" for j in range(i + 1)) + " " + passage, "en") for i in range(20)]
    parsed = collocations.dictionary(frame(spark, rows)).collect()
    assert len(parsed) < 200 < sum(r["times"] for r in parsed) / 4


def test_collocations_of_nothing(spark):
    docs = frame(spark, [(1, None, None), (2, " ", "en")])
    assert collocations.collocations(docs).count() == 0 == collocations.collocations(docs.limit(0)).count()
    with pytest.raises(ValueError):
        collocations.collocations(docs, most_words=6)


def test_one_long_text(spark):
    text = "alpha beta gamma delta " * 500_000
    got = collocations.collocations(frame(spark, [(1, text, "en")])).collect()
    assert [(r["phrase"], r["a"]) for r in got if len(r["phrase"].split()) == 4][0][1] in (499_999, 500_000)
    assert {r["n"] for r in got} == {2_000_000}


# -- ranked search --------------------------------------------------------------------------------------------


def ranked(rows, items, first=10):
    docs = [(key, Counter(TERM.findall(lower(text)))) for key, text, *_ in rows]
    docs = [(key, terms, sum(terms.values())) for key, terms in docs if terms]
    n_docs, n_words = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, terms, _ in docs for t in terms)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for key, terms, n in docs:
            m = 10 + 90 * n * n_docs // n_words
            score = 0
            for t in set(TERM.findall(lower(text))):
                if t in terms:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * terms[t]) // (1000 * terms[t] + 8 * m))
            if score > 0:
                scored.append((-score, key is not None, key or 0, key))
        for rank, (score, _, _, key) in enumerate(sorted(scored, key=lambda r: r[:3])[:first], 1):
            out.append((item, rank, key, -score))
    return sorted(out, key=str)


def search_rows(seed=3):
    rng = np.random.default_rng(seed)
    names = np.array([f"w{i}" for i in range(150)])
    chance = 1 / np.arange(1, 151)
    rows = [
        (i, " ".join(rng.choice(names, int(rng.integers(1, 40)), p=chance / chance.sum())), "en") for i in range(400)
    ]
    rows += [(500 + i, rows[3][1], "en") for i in range(60)]  # copies: ties
    rows += [(i, rows[7][1] + " w9", "en") for i in (3, 3, 4)]  # ids that repeat
    rows += [(None, rows[3][1], "en"), (900, None, "en"), (901, "", "en"), (902, "?!", None)]
    return rows + [(903, "W1 w2-w3_W4é日 " * 9000, "en"), (904, "W1", "en")]


ITEMS = [
    (0, "w1 w2, W3 w3 w100 unknown"),
    (1, "w140 w149 w120 w77"),
    (2, None),
    (3, "..."),
    (4, "nothing here"),
    (5, "W4é日"),
    (5, "w50 w51"),
    (6, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"),
    (1, "w140 w149 w120 w77"),
    (None, "w10 w11 w12"),
]


@pytest.mark.parametrize("segment, seeds, block_words", [(1024, 16, 400_000), (4, 1, 400_000), (7, 3, 12)])
def test_ranked_search(spark, segment, seeds, block_words):
    rows = search_rows()
    docs = frame(spark, rows).withColumn("score", F.lit("clash")).withColumn("item_id", F.lit(1)).repartition(6)
    items = spark.createDataFrame(ITEMS, "item_id int, text string").withColumn("rank", F.lit(0))
    got = lexical.ranked_search(docs, items, segment=segment, seeds=seeds, block_words=block_words)
    assert dict(got.dtypes) == {"item_id": "int", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == ranked(rows, ITEMS)


def test_segments_hold_one_normaliser_and_bound_it(spark):
    docs = frame(spark, search_rows())
    items = lexical._items(ITEMS)
    index = lexical.build(docs, items.vocabulary, segment=16)
    items.weights = lexical.weights(index.n_docs, index.frequencies)
    held = 0
    for row in index.segments.collect():
        assert 0 < len(row["keys"]) <= 16
        held += len(row["keys"])
        arrays = tuple(np.array(row[c]) for c in ("terms", "starts", "tfs", "places"))
        bounds = lexical._gains(items, row["m"], arrays[0], np.array(row["tops"]))
        scored = dict(lexical._scores(items, row["m"], len(row["keys"]), arrays, np.arange(len(items.keys))))
        assert all(scores.max() <= bounds[item] for item, scores in scored.items())
        for a, b in zip(row["starts"], row["starts"][1:]):
            assert row["tfs"][a:b] == sorted(row["tfs"][a:b], reverse=True)
    # Every document that holds a term of the items is in one segment.
    known = {t for _, text in ITEMS for t in TERM.findall(lower(text))}
    assert held == sum(bool(known & set(TERM.findall(lower(text)))) for _, text, _ in search_rows())


def test_ranked_search_of_nothing(spark):
    docs = frame(spark, search_rows()[:20])
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert lexical.ranked_search(docs, items.limit(0)).count() == 0
    none = lexical.ranked_search(docs.limit(0), items)
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
    keyed = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert lexical.ranked_search(keyed, items).first()["doc_id"].startswith("d")
