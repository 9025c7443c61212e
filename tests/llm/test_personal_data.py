"""Personal data: patterns and decoding against plain Python, the field on held-out and planted rows."""

import itertools
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from custlens.llm import personal_data as pd_

FOLDER = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def patterns(text):
    found = []
    for order, (kind, pattern) in enumerate(zip(pd_.BASE, (EMAIL, IP, CARD, PHONE))):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, m.end()))
    return sorted(found)


ODD = [
    None,
    "",
    "a@b a@b.c x@@y.z a@b.c@d.e .@-.- é@é.com mail:jo.e+x@ex-1.co.uk.",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.0000255 001.2.3.4.300 1.2.3 1..2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 4111  1111 1111 1111 41111111111111111111",
    "+1 (017) 555-7713 +49 30 1234567 ++1 22 333 4444 +1 + +123456789012345 +1234567890123456 +1 (((",
    "été +33 1 23 45 67 89 ñ 10.0.0.1 日本 a.b@c.de",
    "+4111111111111111 1.1.1.1@2.2.2.2",
]


def test_patterns():
    rng = np.random.default_rng(1)
    texts = [t or "" for t in ODD]
    for alphabet in ("0123456789.- +()@a", "01.@-", "ab@.-1 ", "+1 ().-2"):
        texts += ["".join(rng.choice(list(alphabet), 60)) for _ in range(400)]
    for text in texts:
        assert pd_.sure(text) == patterns(text), text


def test_patterns_take_linear_time():
    began = time.perf_counter()
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1 " * 100_000, "a@" * 150_000, "1@" * 150_000):
        pd_.sure(text)
    assert time.perf_counter() - began < 20


@pytest.fixture(scope="module")
def model():
    return pd_.train(tuple(sorted(pd_.labelled_rows())))


def small_field():
    rng = np.random.default_rng(4)
    model = pd_.Field()
    model.steps = np.where(pd_.ALLOWED, rng.normal(size=(pd_.N, pd_.N)), pd_.NEVER)
    return model, rng


def paths(model, emissions):
    """Score of each allowed sequence of states."""
    out = {}
    for path in itertools.product(range(pd_.N), repeat=len(emissions)):
        if pd_.FIRST_ALLOWED[path[0]] and all(pd_.ALLOWED[a, b] for a, b in zip(path, path[1:])):
            steps = sum(model.steps[a, b] for a, b in zip(path, path[1:]))
            out[path] = sum(e[s] for e, s in zip(emissions, path)) + steps
    return out


def test_decoding_finds_the_best_path():
    model, rng = small_field()
    lengths = np.array([1, 2, 3, 4, 4])
    emissions = rng.normal(size=(5, 4, pd_.N)) * 2
    got = model.decode(emissions, lengths)
    for i, n in enumerate(lengths):
        scored = paths(model, emissions[i, :n])
        assert tuple(got[i, :n].tolist()) == max(scored, key=scored.get)


def test_marginals_sum_over_all_paths():
    model, rng = small_field()
    lengths = np.array([1, 3, 4])
    emissions = rng.normal(size=(4, 3, pd_.N))
    total, states, pairs = model.marginals(emissions, lengths)
    want = np.zeros((pd_.N, pd_.N))
    for i, n in enumerate(lengths):
        scored = paths(model, emissions[:n, i])
        z = sum(np.exp(v) for v in scored.values())
        assert np.isclose(total[i], np.log(z))
        for place in range(n):
            for s in range(pd_.N):
                chance = sum(np.exp(v) for path, v in scored.items() if path[place] == s) / z
                assert np.isclose(states[place, i, s], chance)
        for path, v in scored.items():
            for a, b in zip(path, path[1:]):
                want[a, b] += np.exp(v) / z
    assert np.allclose(pairs, want)


def test_training_follows_the_gradient():
    """A step of the fitted likelihood can be checked by differences: fitting must lower the loss on what it saw."""
    rows = tuple(pd_.labelled_rows(80, 5))
    few, many = pd_.train(rows, steps=2), pd_.train(rows, steps=40)
    right = lambda m: sum(len(found(m, text) & set(spans)) for text, spans in map(pd_.unmarked, rows))
    assert right(many) > right(few) and right(many) >= 0.95 * sum(len(pd_.unmarked(r)[1]) for r in rows)


def found(model, text):
    raw = np.frombuffer(text, np.uint8)
    return {(a, kind, b) for _, a, kind, b in pd_.extra(model, raw, np.array([0, len(raw)]))}


def test_field_on_held_out_rows(model):
    hits = wrong = missed = 0
    for text, spans in map(pd_.unmarked, pd_.labelled_rows(1200, seed=99)):
        got = found(model, text)
        hits, wrong, missed = hits + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    print("recall", hits / (hits + missed), "precision", hits / (hits + wrong))
    assert hits / (hits + missed) > 0.92 and hits / (hits + wrong) > 0.95


PLANTED = [
    ("crf_phone", "(377) 555-0271"),
    ("crf_phone", "377-555-0271"),
    ("crf_phone", "377.555.0271"),
    ("crf_email", "jane.doe (at) example.com"),
    ("crf_email", "mario17 [at] mail3.org"),
    ("crf_email", "lee at example dot com"),
    ("crf_card", "4111.1111.1111.1111"),
    ("crf_card", "4111/1111/1111/1111"),
    ("crf_ip", "2001:db8:85a3:8d3:1319:8a2e:370:7348"),
]


def test_planted_beyond_the_patterns(spark, model):
    docs = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect() if r["text"]]
    caught = total = 0
    for i, text in enumerate(docs[:180]):
        kind, value = PLANTED[i % len(PLANTED)]
        at = text.find(" ", len(text) // 2)
        if at < 0:
            continue
        planted = text[: at + 1] + value + text[at:]
        hits = pd_.scan(model, pa.array([planted])).to_pylist()[0]
        total += 1
        caught += (kind, at + 1, at + 1 + len(value)) in set(zip(hits["kinds"], hits["starts"], hits["ends"]))
        assert not any(re.search(p, value) and patterns(value) for p in (EMAIL, PHONE))
    print("planted caught", caught, "of", total)
    assert caught >= 0.9 * total


def test_clean_documents_stay_clean(spark, model):
    """The documents hold only regular forms: what the field adds to them is rare."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    kinds = [k for hits in pd_.scan(model, pa.array(texts)).to_pylist() for k in hits["kinds"]]
    assert sum(k in pd_.BASE for k in kinds) > 30 and sum(k not in pd_.BASE for k in kinds) <= 2


def test_blocks_do_not_matter(model):
    """A long run of tokens is decoded in blocks, with the labels that one piece would have."""
    text = (b"call 555 0271 or mail jane (at) example.com since 1999 1,200 2.5 x " * 40).strip()
    raw = np.frombuffer(text, np.uint8)
    t = pd_.tokens(raw, np.array([0]), np.array([len(raw)]))
    assert len(t.starts) > 4 * pd_.BLOCK
    emissions = model.emissions(model.rows(pd_.features(t)))
    whole = model.decode(emissions[None], np.array([len(emissions)]))[0]
    assert (pd_.label(model, t) == whole).all()


def test_query(spark):
    rows = pd_.op11_personal_data(spark, FOLDER)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    import hashlib

    for r in rows.collect():
        want = patterns(docs[r["doc_id"]])
        listed = ",".join(f"{pd_.BASE[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pd_.BASE] == [sum(w[1] == i for w in want) for i in range(4)]
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert ",".join(":".join(s) for s in spans if s[0] in pd_.BASE) == listed
        assert spans == sorted(spans, key=lambda s: (int(s[1]), pd_.KINDS.index(s[0])))
    assert dict(rows.dtypes)["n_email"] == "bigint" and rows.count() == len(docs)


def test_redact_and_corner_cases(spark):
    texts = [*ODD, "call (377) 555-0271 now", "x" * 200_000 + " 10.0.0.1", "10.0.0.1", "10.0.0.1"]
    docs = spark.createDataFrame([(i, t, "p", i) for i, t in enumerate(texts)], "doc_id int, text string, personal string, `a.b` int")
    hits, name = pd_.find(docs)
    assert name == "personal_"
    for r in hits.collect():
        base = [(a, pd_.BASE.index(k), b) for k, a, b in zip(*(r[name][c] for c in ("kinds", "starts", "ends"))) if k in pd_.BASE]
        assert base == patterns(texts[r["doc_id"]])
    clean = pd_.redact(docs)
    assert clean.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert kept[0] is None and kept[1] == "" and kept[len(texts) - 1] == "[IP]" == kept[len(texts) - 2]
    assert kept[8] == "call [PHONE] now" and kept[6].startswith("été [PHONE] ñ [IP] 日本 [EMAIL]")
    none = spark.createDataFrame([], "marked string")
    only = pd_.find(docs.where(F.col("doc_id") == 8), labelled=none)[0].first()[name]
    assert only["kinds"] == []
    assert pd_.redact(docs.limit(0)).count() == 0
