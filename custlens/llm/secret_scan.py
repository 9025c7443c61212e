"""Secret scan: patterns propose, a character convolutional network decides on everything that looks like a key.

Three patterns find the sure findings. Beside them every long token with a digit is a candidate. A candidate and its
surroundings, ``BEFORE`` and ``AFTER`` bytes, make one window of ``WINDOW`` bytes (a longer candidate makes several, ``HOP``
bytes apart, and has the highest of their scores), on which a convolutional network is trained: positive are the windows whose
part of a candidate touches a sure finding, negative the others. A hash leaves out a fifth of the different windows of all documents. All others
fit the weights: small steps over ``TRAIN_EACH`` windows of either kind with the smallest hash find where to begin, then ``ROUNDS``
steps follow the gradient over every window, either kind weighing one half; tasks add it up in fixed point, so that their order does
not matter. The threshold is the highest that still finds ``RECALL`` of all positives left out. Candidates at or above it that touch
no sure finding are findings of kind ``model``.

Defined cases: a null or empty text has no findings; with fewer than 20 windows of either kind there is no network
and only the patterns decide; equal rows have equal findings; an empty table gives an empty result; other columns
pass. Positions count code points and ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.functions import arrow_udf

from custlens.functions.quantiles import quantile_rows
from custlens.llm.common import column, documents, free_name
from custlens.llm.convnet import Adam, ConvNet
from custlens.session import materialize

# The patterns and the least lengths of their values.
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "model")

_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_DIGIT = re.compile(r"[0-9]")

WINDOW, BEFORE, AFTER = 96, 24, 12
TRAIN_EACH = 1500
ROOM = WINDOW - BEFORE - AFTER - 2
HOP = 18  # a key of ROOM - HOP bytes lies whole in one window
RECALL = 0.98
EPOCHS = 6
ROUNDS, RATE = 16, 0.003
AT_ONCE = 512
# Sums of gradients are whole multiples of one in so many.
FIXED = 2.0**40
MARK = "[SECRET]"
SPANS = "struct<kinds:array<string>,starts:array<int>,ends:array<int>,values:array<int>>"


@dataclass
class SecretNet:
    net: ConvNet
    threshold: float


def sure(text: str) -> list[tuple[int, int, int, int]]:
    """(start, place of the kind in KINDS, end, start of the value) of what the patterns find, in order."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= ASSIGN_LEAST:
                found.append((m.start(), 0, m.end(), m.start(1)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                found.append((m.start(), 1, m.end(), m.start()))
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Every long token with a digit."""
    return [m.span() for m in _TOKEN.finditer(text) if _DIGIT.search(m.group())]


def _touching(span: tuple[int, int], found: list[tuple[int, int, int, int]]) -> bool:
    return any(a < span[1] and span[0] < b for a, _, b, _ in found)


def pieces(span: tuple[int, int]) -> list[tuple[int, int]]:
    """A candidate in overlapping parts of ``ROOM`` bytes at most, which cover it."""
    first, last = span
    begins = range(first, max(first, last - ROOM - 1 + HOP) + 1, HOP) if last - first > ROOM else [first]
    return [(min(a, max(first, last - ROOM)), min(last, min(a, max(first, last - ROOM)) + ROOM)) for a in begins]


def window(text: str, span: tuple[int, int]) -> bytes:
    """A piece of a candidate between two marks, with what stands around it, as ``WINDOW`` bytes."""
    first, last = span
    body = text[first:last].encode("ascii")
    before = text[max(0, first - BEFORE) : first].encode()[-BEFORE:].rjust(BEFORE, b"\0")
    after = text[last : last + AFTER].encode()[:AFTER]
    return (before + b"\x01" + body + b"\x02" + after).ljust(WINDOW, b"\0")


def _windows(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.to_pylist():
        text = text or ""
        spans = [piece for span in candidates(text) for piece in pieces(span)]
        found = sure(text) if spans else []
        out.append([{"seen": window(text, s), "label": int(_touching(s, found))} for s in spans])
    return pa.array(out, pa.list_(pa.struct([("seen", pa.binary()), ("label", pa.int32())])))


def fit(docs: DataFrame, text: str = "text", each: int = TRAIN_EACH) -> SecretNet | None:
    """The network and its threshold, from all different windows of all documents; ``each`` of either kind begin."""
    listed = arrow_udf(_windows, "array<struct<seen:binary,label:int>>")(column(docs, text))
    rows = docs.select(F.explode(listed).alias("c")).select("c.seen", "c.label")
    # A window is there once, so none is both fitted and left out.
    rows = rows.groupBy("seen").agg(F.max("label").alias("label"))
    apart = F.pmod(F.xxhash64("seen", F.lit(1)), F.lit(5)) == 4
    rows = materialize(rows.withColumn("apart", apart).sortWithinPartitions("seen"), "secret-windows")
    counts = {(r["label"], r["apart"]): r["count"] for r in rows.groupBy("label", "apart").count().collect()}
    if min(sum(n for (kind, _), n in counts.items() if kind == label) for label in (0, 1)) < 20:
        return None
    order = F.row_number().over(W.partitionBy("label").orderBy("hash_", "seen"))
    ranked = rows.withColumn("hash_", F.xxhash64("seen")).withColumn("place_", order)
    got = ranked.where(F.col("place_") <= each).select("label", "place_", "seen", "apart").collect()
    got.sort(key=lambda r: (r["place_"], r["label"]))
    examples = [np.frombuffer(bytes(row["seen"]), np.uint8)[None, :] for row in got]
    labels, left = np.array([row["label"] for row in got], float), np.array([row["apart"] for row in got])
    net = ConvNet(chunk=WINDOW, stride=4, width=6, filters=24, hidden=12, seed=9)
    net.fit([e for e, a in zip(examples, left) if not a], labels[~left], epochs=EPOCHS, rate=0.01)
    fitted = {label: counts.get((label, False), 0) for label in (0, 1)}
    adam = Adam(net.weights, RATE, ROUNDS)
    for _ in range(ROUNDS):
        adam.move(net.weights, _gradient(net, rows.where(~F.col("apart")), fitted))
    # It keeps the order of the scores, hence the findings do not depend on it.
    net.calibrate([e for e, a in zip(examples, left) if a], labels[left])
    return SecretNet(net, _threshold(net, rows.where("apart and label = 1")))


def _bytes(seen: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(seen.to_pylist()), np.uint8).reshape(-1, WINDOW)


def _gradient(net: ConvNet, rows: DataFrame, counts: dict[int, int]) -> dict[str, np.ndarray]:
    """Gradient over all ``rows``, of which ``counts`` are of each kind."""
    names, share = sorted(net.weights), np.array([0.5 / max(1, counts[label]) for label in (0, 1)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = 0.0
        for batch in batches:
            chunks, labels = _bytes(batch.column(0)), batch.column(1).to_numpy()
            for lo in range(0, len(chunks), AT_ONCE):
                part, kinds = chunks[lo : lo + AT_ONCE], labels[lo : lo + AT_ONCE]
                g = net.gradients(part, np.arange(len(part)), kinds, share[kinds])
                own = own + np.concatenate([g[k].ravel() for k in names]).astype(float)
        if np.ndim(own):
            sums = pa.array(np.rint(own * FIXED).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), sums], ["slot", "sum"])

    sums = rows.select("seen", "label").mapInArrow(add, "slot int, sum long").groupBy("slot").agg(F.sum("sum"))
    flat = np.zeros(sum(net.weights[k].size for k in names))
    for slot, total in sums.collect():
        flat[slot] = total / FIXED
    ends = np.cumsum([net.weights[k].size for k in names])
    parts = np.split(flat.astype(np.float32), ends[:-1])
    return {k: part.reshape(net.weights[k].shape) for k, part in zip(names, parts)}


def _threshold(net: ConvNet, rows: DataFrame) -> float:
    """The highest score that ``RECALL`` of the ``rows`` reach."""

    def score(seen: pa.Array) -> pa.Array:
        chunks, out = _bytes(seen), [np.zeros(0)]
        for lo in range(0, len(chunks), 2048):
            part = chunks[lo : lo + 2048]
            out.append(net.scores(net.pooled(part), np.arange(len(part))))
        return pa.array(np.concatenate(out).astype(float))

    scored = materialize(rows.select(arrow_udf(score, "double")("seen").alias("score")), "secret-scores")
    n = scored.count()
    if not n:
        return 1.0
    # A little above the wanted rank, so that rounding cannot lead below it.
    place = (int((1 - RECALL) * n) + 0.25) / (n - 1) if n > 1 else 0.0
    value = quantile_rows(scored, ["score"], [min(1.0, place)])[0][-1]
    return float(scored.where(F.col("score") <= value).agg(F.max("score")).first()[0])


def scanner(spark, model: SecretNet | None):
    """A function of a text column: all findings, by start and then by kind."""
    shared = spark.sparkContext.broadcast(model)

    def scan(texts: pa.Array) -> pa.Array:
        found, open_, firsts, seen = [], [], [], []
        for row, text in enumerate(texts.to_pylist()):
            text = text or ""
            found.append(sure(text))
            if shared.value is not None:
                for span in candidates(text):
                    if not _touching(span, found[-1]):
                        open_.append((row, span))
                        firsts.append(len(seen))
                        seen += [window(text, piece) for piece in pieces(span)]
        scores = []
        for lo in range(0, len(seen), 2048):
            chunks = np.frombuffer(b"".join(seen[lo : lo + 2048]), np.uint8).reshape(-1, WINDOW)
            net = shared.value.net
            scores.append(net.scores(net.pooled(chunks), np.arange(len(chunks))))
        best = np.maximum.reduceat(np.concatenate(scores), firsts) if seen else []
        for (row, (a, b)), score in zip(open_, best):
            if score >= shared.value.threshold:
                found[row].append((a, 3, b, a))
        out = []
        for spans in found:
            spans = sorted(spans)
            out.append(
                {
                    "kinds": [KINDS[k] for _, k, _, _ in spans],
                    "starts": [a for a, _, _, _ in spans],
                    "ends": [b for _, _, b, _ in spans],
                    "values": [v for _, _, _, v in spans],
                }
            )
        ints = pa.list_(pa.int32())
        kind = pa.struct([("kinds", pa.list_(pa.string())), ("starts", ints), ("ends", ints), ("values", ints)])
        return pa.array(out, kind)

    return arrow_udf(scan, SPANS)


def find(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is returned: ``kinds, starts, ends`` and where ``values`` start."""
    name = free_name(docs, "findings")
    return docs.withColumn(name, scanner(docs.sparkSession, fit(docs, text))(column(docs, text))), name


def _masked(texts: pa.Array, values: pa.Array, ends: pa.Array) -> pa.Array:
    out = []
    for text, firsts, lasts in zip(texts.to_pylist(), values.to_pylist(), ends.to_pylist()):
        if text is not None and firsts:
            kept, at, open_ = [], 0, 0
            for first, last in sorted(zip(firsts, lasts)):
                if first >= open_:
                    kept += [text[at:first], MARK]
                open_ = at = max(at, last)
            text = "".join([*kept, text[at:]])
        out.append(text)
    return pa.array(out, pa.string())


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each secret value replaced by ``MARK``; names before a value stay."""
    found, name = find(docs, text)
    hits = F.col(name)
    masked = arrow_udf(_masked, "string")(column(docs, text), hits["values"], hits["ends"])
    clean = F.when(F.size(hits["starts"]) > 0, masked).otherwise(column(docs, text))
    return found.select(*(column(docs, c) if c != text else clean.alias(text) for c in docs.columns))


def op9_secret_scan(spark, folder):
    found, name = find(documents(spark, folder).select("doc_id", "text"))
    hits = F.arrays_zip(*(F.col(f"{name}.{part}") for part in ("kinds", "starts", "ends"))).alias("hits")
    rows = found.select("doc_id", hits)
    base = F.filter("hits", lambda h: h["kinds"] != "model")
    listed = lambda spans: F.array_join(F.transform(spans, lambda h: F.concat_ws(":", h["kinds"], h["starts"], h["ends"])), ",")
    count = lambda kind: F.size(F.filter("hits", lambda h: h["kinds"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("hits")).alias("spans"),
    )
