"""Operators that compare documents, read conversations or learn, against plain Python and planted cases."""

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from checker import difference
from custlens.llm import chat_tools, language, license_scan, ngram_join, repeats, secret_scan

FOLDER = "/root/testdata/sf0.001"
KINDS = "doc_id bigint, text string, lang string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], KINDS)


def near(n, seed=0, size=60, change=4):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 10_000, size)]
    out = []
    for _ in range(n):
        words = list(base)
        for i in rng.integers(0, size, change):
            words[i] = f"x{rng.integers(0, 10_000)}"
        out.append(" ".join(words))
    return out


def test_ngram_join(spark):
    texts = [None, "", " \n", "a b", "A  b", "a b c d e", "a b c d e f", *near(25, 1), *near(25, 2, 90, 2)]
    texts += [near(1, 1)[0]] * 6 + ["same words here again " * 400] * 2 + ["same words here again " * 401]
    rows = {r["doc_id"]: r for r in ngram_join.linked(frame(spark, texts)).collect()}
    sets = [brute.shingles(t) for t in texts]
    want = brute.components(range(len(texts)), sets)
    assert {i: rows[i]["component_id"] for i in rows} == want
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    compared = ngram_join.linked(frame(spark, texts), hub_turns=0).collect()
    assert {r["doc_id"]: r["component_id"] for r in compared} == want


def test_texts_near_a_group_keep_their_components(spark):
    """Texts that share most shingles but are just too far apart to link, next to ones that link, without hubs."""
    texts = [*near(40, 3, 150, 5), *near(2, 4, 150, 1), *near(2, 5, 700, 8)]
    rows = {r["doc_id"]: r["component_id"] for r in ngram_join.linked(frame(spark, texts), hub_turns=0).collect()}
    assert rows == brute.components(range(len(texts)), [brute.shingles(t) for t in texts])
    assert rows[41] == 40 and rows[43] == 42 and len(set(rows.values())) > 30


def test_only_wanted_texts_are_moved(spark):
    texts = spark.range(20_000).selectExpr("struct(id as key, id % 7 as hash) as key", "'a' as text")
    texts = texts.unionByName(texts.limit(1).selectExpr("null as key", "text"))
    wanted = texts.where("key is null or key.key % 1000 = 3").selectExpr("key as rep")
    left = ngram_join._only(texts, wanted)
    assert left.join(wanted, left["key"].eqNullSafe(wanted["rep"])).count() == 21 and left.count() < 40


def test_one_of_each(spark):
    texts = ["one two three four five six", "One two three four five six", None, None, "alone in the table of texts"]
    docs = frame(spark, texts).unionByName(frame(spark, texts).limit(1)).withColumn("row", F.lit(1))
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4]
    assert ngram_join.linked(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [2000, 2])
def test_repeats(spark, crowd):
    rng = np.random.default_rng(4)
    line = "".join(rng.choice(list("abcdé"), 260))
    own = lambda n: "".join(rng.choice(list("fghij \n"), n))
    texts = [own(50) + line + own(300), line, None, "", own(199), own(30) + line[20:240] + own(9), "ab" * 400, own(500)]
    texts += [own(250) + line[:230] + own(100) + line[5:] for _ in range(4)] + [texts[0]] * 2
    docs = frame(spark, texts)
    got = repeats.dedup(docs, crowd=crowd).orderBy("doc_id").collect()
    found = [(r["n_bytes"], r["n_bytes"] - len(r["kept"]), r["n_spans"], brute.sha(bytes(r["kept"]))) for r in got]
    assert found == brute.repeat_rows(texts)
    first = {r["doc_id"]: bytes(r["kept"]) for r in repeats.dedup(docs, keep="first", crowd=crowd).collect()}
    assert first[0] == texts[0].encode() and first[12] == first[13] == b"" and first[1] == b""
    assert repeats.dedup(docs.limit(0)).count() == 0


def test_crowds_are_parted_by_longer_anchors(spark, monkeypatch):
    """A short passage in many texts makes an anchor with many contexts; its windows do not become rows one by one."""
    rng = np.random.default_rng(6)
    own = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage, far = own(100), own(190)
    texts = [own(200) + passage + own(200) for _ in range(60)] + [own(20) + far + passage + far + own(i) for i in range(6)]
    written, write = {}, repeats.materialize

    def counted(df, name):
        table = write(df, name)
        written.setdefault(name, []).append(table.count())
        return table

    monkeypatch.setattr(repeats, "materialize", counted)
    got = repeats.dedup(frame(spark, texts), crowd=20).orderBy("doc_id").collect()
    found = [(r["n_bytes"], r["n_bytes"] - len(r["kept"]), r["n_spans"], brute.sha(bytes(r["kept"]))) for r in got]
    assert found == brute.repeat_rows(texts) and found[-1][1] > 200
    assert len(written["anchors"]) > 1  # the crowd was parted
    assert max(n for counts in written.values() for n in counts) < 600  # 1,199 windows before


def test_repeats_query(spark):
    rows = repeats.op3_suffix_dedup(spark, FOLDER).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute.repeat_rows([d["text"] for d in docs])


def test_secrets(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += [None, "", "PassWord: 'hunter22' token=abc secret: \"token:abcdefgh\"", "é AKIA" + "A1" * 9, "ſecret=abcdefgh"]
    found, name = secret_scan.find(frame(spark, texts))
    for row in found.collect():
        hits = row[name]
        spans = [s for s in zip(hits["kinds"], hits["starts"], hits["ends"])]
        assert [s for s in spans if s[0] != "model"] == brute.secrets(row["text"]), row["text"]
        assert [s[1] for s in spans] == sorted(s[1] for s in spans)


def test_redaction_and_no_network(spark):
    docs = frame(spark, ["token = \"0123456789abcdef01234567\" end", None, "clean text"])
    assert secret_scan.fit(docs) is None
    assert [r["text"] for r in secret_scan.redact(docs).orderBy("doc_id").collect()] == ['token = "[SECRET]" end', None, "clean text"]
    assert secret_scan.redact(docs.limit(0)).columns == docs.columns


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.op5_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    apart = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == brute.held_out(r["doc_id"]) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in apart]) > 0.98
    model = language.fit(docs)
    names, scores = model.predict([None, "", "123 !!", "ß" * 3, "the and with " * 30])
    assert names[:3] == ["und"] * 3 and scores[:3] == [0.0] * 3 and all(0 <= s <= 1 for s in scores)
    assert language.Languages({}).predict(["words"]) == (["und"], [0.0])
    assert language.identify(docs.limit(0))[0].count() == 0


def test_phrases_are_longest_matches():
    model = language.Languages({"a": ["abcabd xyz"], "b": ["qqq"]})
    points, places, _ = language.folded(["abcabdab", "zzq"])
    assert model.phrases(points, places).tolist()[0][0] == 2


def test_license_corner_cases(spark):
    texts = [None, "", "under the MIT license under the mit license", "Released under the\nMIT license", "cc-by/nc cc by nc"]
    rows = {r["doc_id"]: r for r in license_scan.scan(frame(spark, texts)).collect()}
    assert rows[0]["n_words"] == rows[1]["n_words"] == 0 and rows[0]["score"] == 0
    assert list(rows[2]["places"]) == [0, 4] and rows[2]["base"] == ["mit"]
    assert list(rows[3]["places"]) == [1] and list(rows[4]["places"]) == [0, 3]
    assert license_scan.scan(frame(spark, texts).limit(0)).count() == 0


def test_tool_calls(spark):
    calls = [
        (1, 0, "a", "reply", None, {"text": "x", "turn": "0"}),
        (1, 0, "a", "reply", None, {"text": "x", "turn": "0"}),
        (1, 2, "b", "reply", "a", {"text": "", "turn": "z", "more": "1"}),
        (1, 4, "c", "other", "b", {}),
        (2, 0, "p", "reply", "q", {"text": "x", "turn": "0"}),
        (2, 1, "q", "reply", "p", {"text": "x", "turn": "0"}),
        (3, 0, None, "reply", None, {"turn": "1", "text": "t"}),
    ]
    kind = "conv bigint, turn bigint, id string, name string, after string, arguments map<string,string>"
    results = [(1, 1, "a", "r1"), (1, 1, "a", "r0"), (9, 9, "zz", None), (9, 9, None, "n")]
    results = spark.createDataFrame(results, "conv bigint, turn bigint, call_id string, content string")
    rows = chat_tools.link(spark.createDataFrame(calls, kind), results).collect()
    by = {r["call_id"]: r for r in rows if r["call_id"]}
    assert len(rows) == 8
    assert (by["a"]["status"], by["a"]["level"], by["a"]["n_calls"], by["a"]["n_results"]) == ("linked", 0, 2, 2)
    assert (by["b"]["level"], by["b"]["status"], by["b"]["problems"]) == (1, "open", "more,text,turn")
    assert (by["c"]["level"], by["c"]["problems"]) == (2, "tool:other")
    assert by["p"]["status"] == by["q"]["status"] == "ring" and by["zz"]["status"] == "orphan"
    assert by["a"]["json"].startswith('{"after":null,"arguments":{"text":"x","turn":"0"},"id":"a","level":0')


def test_tool_calls_in_texts(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", '{"tool_calls":[{"id":"k","name":"reply","arguments":{"text":"t","turn":"1"}}]}'),
        (1, 2, "tool", '{"tool_call_id":"k","content":"done"}'),
        (1, 3, "assistant", None),
        (None, 0, "user", None),
    ]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["call_id"]: r["status"] for r in chat_tools.link(*chat_tools.exchanges(messages)).collect()}
    assert got == {"1:0": "open", "k": "linked", "1:2": "orphan", None: "open"}
    assert chat_tools.link(*chat_tools.exchanges(messages.limit(0))).count() == 0


def test_tool_calls_of_each_conversation(spark):
    call = '{"tool_calls":[{"id":"call_%s","name":"reply","after":"call_%s","arguments":{"text":"%s","turn":"1"}}]}'
    rows = []
    for conv in (1, 2, None):
        rows += [(conv, i, "assistant", call % (i, i - 1, f"{conv} asks {i}")) for i in (1, 2)]
    rows += [(conv, 3, "tool", '{"tool_call_id":"call_1","content":"%s"}' % conv) for conv in (2, None, 4)]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat_tools.link(*chat_tools.exchanges(messages)).collect()
    found = {(r["conv_id"], r["call_id"]): (r["status"], r["level"], r["n_calls"], r["n_results"]) for r in got}
    assert len(got) == 7 and found == {
        (1, "call_1"): ("open", 0, 1, 0),
        (1, "call_2"): ("open", 1, 1, 0),
        (2, "call_1"): ("linked", 0, 1, 1),
        (2, "call_2"): ("open", 1, 1, 0),
        (None, "call_1"): ("linked", 0, 1, 1),
        (None, "call_2"): ("open", 1, 1, 0),
        (4, "call_1"): ("orphan", None, 0, 1),
    }
    texts = {(r["conv_id"], r["call_id"]): r["json"] for r in got}
    assert '"text":"2 asks 1"' in texts[2, "call_1"] and '"result":"2"' in texts[2, "call_1"]
    assert '"text":"1 asks 2"' in texts[1, "call_2"] and '"result":"4"' in texts[4, "call_1"]


def test_licenses_over_line_breaks(spark):
    wrapped = [
        (" * This program is free software: you can redistribute it and/or modify\n"
         " * it under the terms of the GNU General Public License", "gpl"),
        ("# Redistribution and use in source and binary forms, with or without\n"
         "# modification, are permitted provided that", "bsd"),
        ("// you may not use this file except in compliance with the License.\n"
         "// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/", "apache-2"),
        ("Released\nunder\n\nthe\nMIT\nlicense", "mit"),
    ]
    # At every place of a longer text, so at every offset in the windows.
    texts = [("filler \n" * n) + text + ("\nmore" * 50) for text, _ in wrapped for n in range(40)]
    wants = [label for _, label in wrapped for _ in range(40)]
    rows = {r["doc_id"]: r for r in license_scan.scan(frame(spark, texts)).collect()}
    assert [want in rows[i]["found"] for i, want in enumerate(wants)] == [True] * len(texts)
    apart = "released under" + "\nfiller" * 60 + "\nthe mit license"
    assert list(license_scan.scan(frame(spark, [apart])).first()["found"]) == []


def test_language_of_large_alphabets(spark):
    han, hangul = ([chr(b + i) for i in range(600)] for b in (0x4E00, 0xAC00))
    rng = np.random.default_rng(8)
    text = lambda letters, n: "".join(rng.choice(letters, n))
    latin, base = list("abcdefghijklmnopqrstuvwxyz   "), {"zh": han, "ko": hangul}
    phrases = {k: [text(v, 6) for _ in range(200)] for k, v in base.items()}
    say = lambda k, n: "".join(rng.choice(phrases[k], n))
    model = language.Languages({"aa": [text(latin, 2000)], "ko": [say("ko", 700)], "zh": [say("zh", 700)]})
    names, scores = model.predict([say("zh", 20), say("ko", 20), text(latin, 200), "\u0e01\u0e02\u0e03"])
    assert names == ["zh", "ko", "aa", "und"] and scores[3] == 0 and min(scores[:3]) > 0.5
    points, places, _ = language.folded([say("zh", 20)])
    costs = model.phrases(points, places)[:, 0]
    assert costs[2] < 60 < costs[1] == 120  # Hangul knows no Han letter: one phrase each


def test_language_learns_from_long_texts(spark):
    docs = spark.createDataFrame([(i, "so lang " * 700, "x") for i in range(20)], KINDS)
    model = language.fit(docs)
    assert model.names == ["x"] and 0 < model.bits[0] < 15
    assert model.predict(["so lang"])[0] == ["x"]


def test_long_candidates_are_seen_whole():
    for n in range(12, 400):
        parts = secret_scan.pieces((5, 5 + n))
        assert parts[0][0] == 5 and parts[-1][1] == 5 + n and len(set(parts)) == len(parts)
        assert all(0 < b - a <= secret_scan.ROOM for a, b in parts)
        for a in range(5, 5 + n - 40 + 1):
            assert any(x <= a and a + 40 <= y for x, y in parts), (n, a)
    text = "path=" + "a1/" * 100
    assert all(len(secret_scan.window(text, p)) == secret_scan.WINDOW for p in secret_scan.pieces((5, 305)))


def test_secret_windows_are_different_and_threshold_free(spark, monkeypatch):
    seen = {}

    class Net(secret_scan.ConvNet):
        def fit(self, examples, labels, **more):
            seen["fitted"] = [e.tobytes() for e in examples]
            return self

        def calibrate(self, examples, labels):
            seen["left"] = [e.tobytes() for e in examples]

        def scores(self, best, firsts):
            return np.full(len(firsts), 0.25)

    monkeypatch.setattr(secret_scan, "ConvNet", Net)
    texts = [f"token={i:08d}abcdefgh and part{i:012d} end" for i in range(60)]
    model = secret_scan.fit(frame(spark, texts + texts[:1] * 500))
    every = seen["fitted"] + seen["left"]
    assert len(every) == len(set(every)) == 120
    assert model.threshold == 0.25


def test_secrets_learn_from_every_window(spark, monkeypatch):
    texts = [f"token={i:08d}abcdefgh and part{i:012d} end" for i in range(300)]
    docs, used = frame(spark, texts), {"fit": 0}
    gradient, threshold = secret_scan._gradient, secret_scan._threshold

    def spied_gradient(net, rows, counts):
        used["fit"] = rows.count()
        assert used["fit"] == sum(counts.values())
        g = gradient(net, rows, counts)
        got = [(bytes(r["seen"]), r["label"]) for r in rows.collect()]
        chunks, labels = np.stack([np.frombuffer(s, np.uint8) for s, _ in got]), np.array([k for _, k in got])
        share = np.array([0.5 / counts[k] for k in labels])
        for name, value in net.gradients(chunks, np.arange(len(chunks)), labels, share).items():
            assert g[name] == pytest.approx(value, abs=1e-5)
        return g

    def spied_threshold(net, rows):
        chunks = np.stack([np.frombuffer(bytes(r["seen"]), np.uint8) for r in rows.collect()])
        scores = np.sort(net.scores(net.pooled(chunks), np.arange(len(chunks))))
        used["left"], found = len(scores), threshold(net, rows)
        assert found == pytest.approx(scores[int((1 - secret_scan.RECALL) * len(scores))], abs=1e-6)
        return found

    monkeypatch.setattr(secret_scan, "_gradient", spied_gradient)
    monkeypatch.setattr(secret_scan, "_threshold", spied_threshold)
    monkeypatch.setattr(secret_scan, "ROUNDS", 2)
    secret_scan.fit(docs, each=40)
    assert used["fit"] > 400 and 40 < used["left"] < 80


def test_scattered_words_are_no_license(spark):
    wording = "licensed under the gnu general public license version".split()
    line = " ".join(f"{w} " + " ".join(f"x{i}" for i in range(400)) for w in reversed(wording))
    near = " ".join(f"{w} " + " ".join(f"x{i}" for i in range(6)) for w in wording)
    whole = " ".join(["y"] * 3001 + wording + ["z"] * 5000)
    rows = {r["doc_id"]: r for r in license_scan.scan(frame(spark, [line, near, whole, line.replace("x399", "x399\n")])).collect()}
    found = [list(rows[i]["found"]) for i in sorted(rows)]
    assert found == [[], [], ["gpl", "lgpl"], []]  # eight of the nine words of the other wording


def test_whole_license_text_as_template(spark):
    text = " ".join(f"w{i}" for i in range(300))
    templates = [("long", text), ("mit", "released under the mit license")]
    cut = " ".join(f"w{i}" for i in range(300) if i % 10)  # nine of ten words are left
    less = " ".join(f"w{i}" for i in range(300) if i % 5)
    texts = ["a " * 777 + cut, less, "b " * 130 + text + " released under the mit license"]
    rows = {r["doc_id"]: list(r["found"]) for r in license_scan.scan(frame(spark, texts), templates=templates).collect()}
    assert [rows[i] for i in sorted(rows)] == [["long"], [], ["long", "mit"]]


def test_tool_calls_lose_no_message(spark):
    nested = '{"tool_calls":[{"id":"f","function":{"name":"reply","arguments":"{\\"turn\\":3,\\"text\\":\\"deep\\"}"}}]}'
    plain = nested.replace('"id":"f"', '"id":"g"').replace('"{\\"turn\\":3,\\"text\\":\\"deep\\"}"', '{"turn":3,"text":"deep"}')
    rows = [
        ("x-1", "0", "system", "be kind"),
        ("x-1", "0", "system", "be kind"),
        ("x-1", "1", "user", "b"),
        ("x-1", "1", "user", "a"),
        ("x-1", "1", "user", "b"),
        ("x-1", "2", "assistant", "z"),
        ("x-1", "2", "assistant", "y"),
        ("x-1", "2", "critic", ""),
        ("x-1", "no number", None, None),
        ("x-1", "3", "assistant", nested),
        ("x-1", "4", "assistant", plain),
    ]
    messages = spark.createDataFrame(rows, "conv_id string, turn string, role string, text string").withColumn("ID", F.lit(1))
    got = chat_tools.formatted(messages).collect()
    seen = sorted((r["status"], r["call_id"] or "", r["n_calls"], r["n_results"]) for r in got)
    assert seen == [
        ("conflict", "x-1:1", 0, 1),
        ("conflict", "x-1:1", 2, 0),
        ("linked", "x-1:1", 3, 2),
        ("message", "", 0, 1),
        ("message", "x-1:0", 0, 2),
        ("message", "x-1:2", 0, 1),
        ("open", "f", 1, 0),
        ("open", "g", 1, 0),
    ]
    texts = " ".join(r["json"] for r in got)
    for part in ("be kind", '"text":"a"', '"text":"b"', '"result":"y"', '"result":"z"', '"name":"critic"'):
        assert part in texts
    calls = {r["call_id"]: r for r in got if r["call_id"] in ("f", "g")}
    assert all(r["problems"] == "" and '"arguments":{"text":"deep","turn":"3"}' in r["json"] for r in calls.values())
    assert chat_tools.formatted(messages.limit(0)).count() == 0


def test_conflicts_match_sql(spark, tmp_path):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "z"), (1, 2, "assistant", "y"), (2, 0, "other", "o")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert difference(chat_tools.op2_tool_calls(spark, str(tmp_path)), con, chat_tools.OP2_SQL) is None
