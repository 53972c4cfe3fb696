"""Training of the language model sees the whole of every text."""

import subprocess
import sys

import numpy as np
import zstandard
from pyspark.sql import functions as F

from chronolens.llm import lm_scoring, queries


def test_training_windows_cover_every_id(spark):
    """All subword ids of all texts, and their ends, are targets of training once, each after the id before it."""
    file = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    words = F.transform(F.sequence(F.lit(1), F.col("id") * 20 + 1), lambda k: F.concat(F.lit("Word"), (k % 17).cast("string")))
    texts = spark.range(40).select(F.when(F.col("id") > 0, F.concat_ws(" ", words)).otherwise("").alias("text"), "id")
    vocab = lm_scoring.vocabulary_of(lm_scoring.id_statistics(lm_scoring.word_counts(texts), file), 40)
    got = lm_scoring.training_windows(texts, file, vocab).collect()
    encode = lm_scoring.load_ranks(file).encode_ordinary
    want = [[*(i for w in r["text"].lower().split() for i in encode(" " + w)), lm_scoring.END] for r in texts.collect()]
    pairs = []
    for ids in want:
        pairs += zip(vocab.symbol[[lm_scoring.BOS, *ids[:-1]]].tolist(), vocab.cls[ids].tolist(), strict=True)
    x, y = (np.concatenate([np.frombuffer(r[c], np.int16) for r in got]) for c in "xy")
    assert sorted(zip(x[y >= 0].tolist(), y[y >= 0].tolist(), strict=True)) == sorted(pairs)


def test_windows_are_stored_in_two_bytes_an_id(spark):
    """A window is its ids and the one before it; symbols and classes are looked up where they are trained on."""
    file = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    texts = spark.createDataFrame([("some words " * 50,), ("",), ("one",)], "text string")
    encode = lm_scoring.load_ranks(file).encode_ordinary
    got = [np.frombuffer(r["w"], np.uint16).tolist() for r in lm_scoring.stored_windows(texts, file).collect()]
    want = []
    for r in texts.collect():
        ids = [lm_scoring.BOS, *(i for w in r["text"].split() for i in encode(" " + w)), lm_scoring.END]
        cut = [ids[k : k + lm_scoring.WINDOW + 1] for k in range(0, len(ids) - 1, lm_scoring.WINDOW)]
        want += [c + [lm_scoring.PAST] * (lm_scoring.WINDOW + 1 - len(c)) for c in cut]
    assert sorted(got) == sorted(want)


def test_windows_shuffle_once_and_packed(spark):
    """A row for each shard: the same windows in the order of their hashes, dealt as Spark deals the hashes, in less than 2 bytes an id."""
    file = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    words = F.transform(F.sequence(F.lit(1), F.col("id") % 300 + 1), lambda k: F.concat(F.lit("w"), (k * 7919 % 997).cast("string")))
    texts = spark.range(600).select(F.concat_ws(" ", words).alias("text"), F.xxhash64(F.col("id") % 590).alias("h"))  # ten rows occur twice
    for shards in (1, 5, 40):
        rows = lm_scoring.stored_windows(texts, file).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))).toPandas().sort_values(["shard", "h", "w"])
        want = {k: b"".join(part["w"]) for k, part in rows.groupby("shard")}
        got = lm_scoring.dealt_windows(texts.repartition(3), file, shards).collect()
        assert {r["shard"]: zstandard.decompress(r["w"]) for r in got} == want and len(got) == len(want)
        assert sum(r["n"] for r in got) == len(rows) and sum(len(r["w"]) for r in got) < sum(map(len, want.values()))


def test_rounds_read_windows_without_a_shuffle(spark, monkeypatch):
    """The table that rounds train on is dealt when it is written: neither its plan nor a round's moves windows again."""
    file = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    texts = spark.range(20).select(F.concat_ws(" ", F.lit("some words"), "id").alias("text"), F.xxhash64("id").alias("h"))
    vocab = lm_scoring.vocabulary_of(lm_scoring.id_statistics(lm_scoring.word_counts(texts), file), 20)
    kept, write = {}, lm_scoring.materialise
    monkeypatch.setattr(lm_scoring, "materialise", lambda df, tag: kept.setdefault(tag, write(df, tag)))
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    params = lm_scoring.train(texts, file, vocab)
    assert kept["lm-windows"].columns == ["shard", "n", "w"] and kept["lm-windows"].count() == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows
    (row,) = kept["lm-windows"].collect()
    x, y = lm_scoring.symbols_of(lm_scoring.unpacked([zstandard.decompress(row["w"])]), vocab)
    want = lm_scoring.new_params(vocab.prior)
    for r in range(lm_scoring.ROUNDS):
        want = lm_scoring.train_local(want, x, y, r, r)
    assert all(np.allclose(params[k], want[k], rtol=1e-5, atol=1e-6) for k in want)


def test_training_keeps_its_memory():
    """Steps of training take the arrays that the steps before have freed, not new pages of the system (674 a step before)."""
    work = """
import resource, sys
import numpy as np
from chronolens.llm import common, lm_scoring as L
rng = np.random.default_rng(0)
x, y = rng.integers(0, L.N_SYMBOLS, (3200, L.WINDOW)).astype(np.int16), rng.integers(0, L.CLASSES, (3200, L.WINDOW)).astype(np.int16)
common.keep_memory()
p = L.train_local(L.new_params(np.zeros(L.CLASSES)), x[:320], y[:320], 0, 0)
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
L.train_local(p, x, y, 0, 0)
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / 100)
"""
    assert float(subprocess.run([sys.executable, "-c", work], check=True, capture_output=True, text=True).stdout) < 60
