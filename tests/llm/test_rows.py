"""Operators that look at one document at a time, against plain Python."""

import brute
import numpy as np
import pytest

from custlens.llm import catalog, decontaminate, mixing, quality_net, quality_rules
from custlens.llm.automaton import SuffixAutomaton
from custlens.llm.textbytes import SPACED, Rolling, buffers, words

FOLDER = "/root/testdata/sf0.001"
ODD = [
    None,
    "",
    " \n\t ",
    "one",
    "a a a a a a a a",
    "Line one\nline two\nLine one\n\n\n \nLine one",
    "été *** ça $$$\x0b\x0cx\x1cy z",
    "x" * 300_000,
    "the cat sat on the mat " * 3000,
    "\n".join(["same words in a line"] * 50),
]


def documents(spark, texts, **more):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_words_do_not_cross_texts():
    import pyarrow as pa

    data, places = buffers(pa.array(["ab", None, "cd e", "", "f"]))
    rows, starts, ends = words(data, places, SPACED)
    assert rows.tolist() == [0, 2, 2, 4]
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"cd", b"e", b"f"]
    sliced = pa.array(["zz", "ab", "cd"])[1:]
    assert bytes(buffers(sliced)[0]) == b"abcd"
    again = Rolling(np.frombuffer(b"abcab", np.uint8)).hashes(np.array([0, 3]), np.array([2, 5]))
    assert again[0] == again[1]


def test_rule_signals(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()] + ODD
    rows = {r["doc_id"]: r for r in quality_rules.weigh(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert tuple(rows[i][s] for s in quality_rules.SIGNALS[:5]) == brute.rule_signals(text), text
    assert all(0 <= r["posterior"] <= 1 for r in rows.values())


def test_rules_find_planted_classes():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.8
    votes = np.where(good[:, None], 1, -1) * np.where(rng.random((4000, 5)) < 0.85, 1, -1)
    votes = votes * (rng.random((4000, 5)) < 0.7)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, chances = quality_rules.estimate(patterns, counts.astype(float))
    code = {tuple(p): q for p, q in zip(patterns.tolist(), posterior)}
    found = np.array([code[tuple(v)] >= 0.5 for v in votes.tolist()])
    assert (found == good).mean() > 0.9
    assert (chances[1] > chances[0]).all()


def test_rules_agree_with_labels(spark):
    rows = quality_rules.op1_quality_rules(spark, "/root/testdata/sf0.1").where("not base_failed")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    both = rows.join(labels, "doc_id").groupBy("quality").avg("posterior").collect()
    mean = {r["quality"]: r[1] for r in both}
    assert mean[1] > 0.95 and mean[0] < 0.4


def test_rules_on_nothing(spark):
    assert quality_rules.weigh(documents(spark, [])).count() == 0


ITEMS = [
    ("a", "one two three four five six seven eight nine ten eleven twelve"),
    ("b", "Alpha, beta gamma!"),
    ("c", "beta gamma"),
    ("d", None),
    ("e", ""),
    ("f", "two three four five six seven eight nine ten eleven"),
    ("g", "solo"),
    ("h", "na na na na na na na na na na na"),
    (None, "null item words here"),
    ("b", "Alpha beta gamma"),
]
TEXTS = [
    None,
    "",
    "zero one two three four five six seven eight nine ten eleven twelve thirteen",
    "one two three four five six seven eight nine",
    "ALPHA beta-gamma delta beta gamma",
    "xx SOLO xx solo",
    "na " * 30,
    "a null item words here b null item words",
    "beta " * 5 + "gamma" + " one two three four five six seven eight nine ten" * 2,
    "one two three four five six seven eight nine ten" * 3,
]


@pytest.mark.parametrize("shard_words", [1_000_000, 12])
def test_decontamination(spark, shard_words):
    docs = documents(spark, TEXTS)
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    found, name = decontaminate.find(docs, items, shard_words=shard_words)
    for row, want in zip(sorted(found.collect(), key=lambda r: r["doc_id"]), brute.contamination(TEXTS, ITEMS)):
        hits = row[name]
        n_hit = sum(b - a for a, b in zip(hits["starts"], hits["ends"]))
        assert (hits["n_words"], n_hit, len(hits["items"]), bool(hits["starts"])) == (*want[:3], want[4]), row
        assert brute.sha(",".join(sorted(hits["items"]))) == want[3]


def test_decontamination_query(spark):
    rows = catalog.QUERIES["op6_decontamination"](spark, FOLDER).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert [tuple(r)[1:] for r in rows] == brute.contamination([d["text"] for d in docs], items)
    assert any(r["contaminated"] for r in rows)


def test_decontamination_cuts_and_keeps(spark):
    item = " ".join(f"w{i}" for i in range(12))
    texts = ["clean text stays as it is", "é " * 30 + item + " tail of the text " * 3, item, None]
    items = spark.createDataFrame([("a", item)], "item_id string, text string")
    docs = documents(spark, texts)
    kept = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, items).collect()}
    assert kept == {0: texts[0], 1: texts[1].replace(item, ""), 3: None}
    none = decontaminate.decontaminate(docs, items.limit(0)).collect()
    assert len(none) == 4
    assert decontaminate.decontaminate(docs.limit(0), items).columns == docs.columns


def test_automaton_accepts_exactly_the_runs():
    rng = np.random.default_rng(3)
    items = [rng.integers(0, 3, rng.integers(1, 12)).tolist() for _ in range(30)]
    automaton = SuffixAutomaton()
    for item in items:
        automaton.add(item)
    runs = {tuple(x[i:j]) for x in items for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    for _ in range(300):
        stream, state, matched = rng.integers(0, 4, 15).tolist(), 0, 0
        for i, symbol in enumerate(stream):
            state, matched = automaton.step(state, matched, symbol)
            best = max((n for n in range(i + 2) if n == 0 or tuple(stream[i + 1 - n : i + 1]) in runs))
            assert matched == best


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (i % 7), s) for i, s in enumerate(["a"] * 50 + ["b"] * 20 + [None] * 5 + ["c"] * 10)]
    rows += [(1, "w w w", "a")] * 3 + [(99, None, "a"), (100, "", "z"), (None, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    words = {}
    for r in got:
        words[r["source"]] = words.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]
    aims = {r["source"]: r["target"] for r in got}
    assert all(abs(words[s] - aims[s]) <= 0.5 for s in aims)
    total = sum(r["size"] for r in got)
    assert abs(sum(aims.values()) - 1.5 * total) < 1e-6
    # what is not capped shares by weight: a 5, b 2, c 1, z 5, null 2
    open_ = {s: aims[s] / w for s, w in {"a": 5, "b": 2, "c": 1, None: 2}.items() if aims[s] < 2 * words[s] / 2}
    sizes = {r["source"]: r["source_size"] for r in got}
    levels = {round(aims[s] / w, 9) for s, w in {"a": 5, "b": 2, "c": 1, None: 2}.items() if aims[s] < 2 * sizes[s]}
    assert len(levels) <= 1 and open_ is not None
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_buckets_do_not_matter(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sized = mixing.sizes(docs)
    few = mixing.take(sized, "doc_id", buckets=4).groupBy("source").agg({"taken": "sum"}).collect()
    many = mixing.take(sized, "doc_id").groupBy("source").agg({"taken": "sum"}).collect()
    assert sorted(map(str, few)) == sorted(map(str, many))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_documents(spark):
    docs = documents(spark, ["a b c", " d  e\n", None, "f"] * 20).withColumn("copy", documents(spark, []).schema and mixing.F.lit(1))
    got = mixing.mixed_documents(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and "copy_" in got.columns
    for r in got.collect():
        assert len(r["text"].split()) == r["words"]
    assert got.agg({"words": "sum"}).first()[0] == 180


def test_classifier_on_held_out_labels(spark):
    scored = catalog.QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    good = np.array([r["score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["score"] for r in rows if r["quality"] == 0])
    print("accuracy", right, "auc", (good[:, None] > bad[None, :]).mean(), "clean kept", (good >= 0.7).mean())
    assert right > 0.93 and (good[:, None] > bad[None, :]).mean() > 0.93 and (good >= 0.7).mean() > 0.97


def test_classifier_corner_cases(spark):
    docs = documents(spark, ODD).withColumn("score", mixing.F.lit("x"))
    labels = spark.createDataFrame([(0, 1), (1, None), (999, 0)], "doc_id bigint, quality int")
    scored, name = quality_net.classify(docs, labels)
    assert name == "score_" and all(0 <= r[name] <= 1 for r in scored.collect())
    real = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality_net.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), real)
    got = docs.select(quality_net.scorer(spark, model)("text").alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in got)
    assert quality_net.classify(docs.limit(0), real)[0].count() == 0
    assert quality_net.fit(docs, labels.limit(0)) == 0.5
