"""Quality classifier: a byte-level convolutional network over overlapping chunks of the whole document.

It is fitted on a bounded sample of labelled rows that are not held out: the ``TRAIN_ROWS`` rows with the smallest
hash of their id, of texts up to ``TRAIN_BYTES`` bytes, four fifths for the weights and one fifth for the
calibration. Scoring covers every byte of every text. Labels, lang, source and doc_id are no inputs.

Defined cases: a null or empty text is one chunk of zero bytes and has a score like any other; null labels and ids
without a document teach nothing; a doc_id labelled twice teaches twice; without both labels in the sample every
score is the share of good rows (0.5 if there are none); an empty table gives an empty result. Other columns pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from custlens.llm.common import column, documents, free_name, held_out
from custlens.llm.convnet import ConvNet, cut
from custlens.llm.textbytes import buffers, slices

TRAIN_ROWS = 2500
TRAIN_BYTES = 12_000
EPOCHS = 8
HOP = 224
GOOD_FROM = 0.7


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS):
    """A network, or the share of good rows where there is nothing to tell apart."""
    usable = labels.select(F.col(key).alias("key_"), F.col("quality").cast("int").alias("quality_")).where(
        ~held_out(F.col("key_")) & F.col("quality_").isin(0, 1)
    )
    # Twice the rows, as some have no document or too long a text.
    chosen = usable.orderBy(F.xxhash64("key_"), "key_", "quality_").limit(2 * rows)
    texts = docs.select(column(docs, key).alias("key_"), column(docs, text).alias("text_"))
    taught = texts.join(F.broadcast(chosen), "key_").where(F.octet_length("text_") <= TRAIN_BYTES)
    got = taught.orderBy(F.xxhash64("key_"), "key_", F.xxhash64("text_"), "quality_").limit(rows).collect()
    goods = np.array([r["quality_"] for r in got], dtype=float)
    if len(got) < 20 or goods.min() == goods.max():
        return float(goods.mean()) if len(got) else 0.5
    net, examples = ConvNet(), []
    data, places = buffers(pa.array([r["text_"] for r in got], pa.string()))
    chunks, firsts = cut(data, places, net.chunk, HOP)
    examples = np.split(chunks, firsts[1:])
    apart = np.arange(len(got)) % 5 == 4
    net.fit([e for e, a in zip(examples, apart) if not a], goods[~apart], epochs=EPOCHS)
    net.calibrate([e for e, a in zip(examples, apart) if a], goods[apart])
    return net


def scorer(spark, model):
    """A function of a text column: the chance that its label is 1."""
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        net = shared.value
        if not isinstance(net, ConvNet):
            return pa.array(np.full(len(texts), net))
        data, places = buffers(texts)
        out = [np.zeros(0)]
        for lo, hi in slices(places, 400_000):
            part, own = data[places[lo] : places[hi]], places[lo : hi + 1] - places[lo]
            chunks, firsts = cut(part, own, net.chunk, HOP)
            best = [net.pooled(chunks[a : a + 1024]) for a in range(0, len(chunks), 1024)]
            out.append(net.scores(np.concatenate(best), firsts))
        return pa.array(np.concatenate(out))

    return score


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is returned: the score."""
    model = fit(docs, labels, key, text)
    name = free_name(docs, "score")
    return docs.withColumn(name, scorer(docs.sparkSession, model)(column(docs, text))), name


def good_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    scored, name = classify(docs, labels, key, text)
    return scored.where(F.col(name) >= GOOD_FROM).drop(name)


def op10_quality_classifier(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    scored, name = classify(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col(name).alias("score"),
        (F.col(name) >= GOOD_FROM).cast("int").alias("predicted"),
    )
