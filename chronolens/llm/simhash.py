"""SimHash near-duplicates with pigeonring candidate filtering.

The 64 bits are five segments on a ring. If two fingerprints differ in at most four bits, then
from some segment on, every chain of l consecutive segments differs in at most l*4/5 bits:
the first segment not at all, the first two in one bit, three in two, four in three. Rows meet
under keys made of a segment and the next one, or the next one with one bit turned; chains are
checked on, and the full Hamming distance comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

BITS, MAX_DISTANCE = 64, 4
#: (first bit, bits) of each segment: one more segment than bits that may differ.
SEGMENTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Runs of a key with more pairs than this are linked by breadth-first search instead of pair by pair.
PAIRS_IN_RUN = 20_000


def fingerprint_udf(shingle: int = 4, seed: int = 42):
    """UDF: text as UTF-8 -> fingerprint as long (bits of an unsigned number); null and no words give zero."""

    @F.pandas_udf("long")
    def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for s in texts:
            out = np.zeros(len(s), np.uint64)
            for n, t in enumerate(s):
                words = t.lower().split() if t is not None else []
                if not words:
                    continue
                line = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                starts = np.concatenate([[0], ends[:-1]])
                if len(words) >= shingle:
                    spans = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
                    h = np.array([digest(line[a:b], seed) for a, b in spans], np.uint64)
                else:
                    h = np.array([digest(line, seed)], np.uint64)
                count = np.zeros(BITS, np.int64)
                for at in range(0, len(h), 4096):
                    part = h[at : at + 4096].view(np.uint8).reshape(-1, 8)
                    count += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
                out[n] = np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0]
            yield pd.Series(out.view(np.int64))

    return fingerprint


def _segment(x: np.ndarray, i: int) -> np.ndarray:
    at, n = SEGMENTS[i % len(SEGMENTS)]
    return (x >> np.uint64(at)) & np.uint64((1 << n) - 1)


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each fingerprint under its own keys (own = 1) and under those with one bit of the second segment turned (0)."""
    for pdf in batches:
        f = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        for i in range(len(SEGMENTS)):
            head = (np.uint64(i) << np.uint64(26)) | (_segment(f, i) << np.uint64(13))
            second = _segment(f, i + 1)
            for turn in (0, *(1 << b for b in range(SEGMENTS[(i + 1) % len(SEGMENTS)][1]))):
                key = (head | (second ^ np.uint64(turn))).astype(np.int64)
                yield pd.DataFrame({"key": key, "own": np.int8(turn == 0), "fp": f.view(np.int64)})


def chains_fit(x: np.ndarray, i: np.ndarray) -> np.ndarray:
    """For differences x (a xor b) met at segment i: do all chains from i on keep their budgets, the whole ring last?"""
    counts = np.stack([np.bitwise_count(_segment(x, s)) for s in range(len(SEGMENTS))], axis=1).astype(np.int64)
    ring = (i[:, None] + np.arange(len(SEGMENTS))) % len(SEGMENTS)
    total = np.cumsum(np.take_along_axis(counts, ring, axis=1), axis=1)
    budgets = MAX_DISTANCE * np.arange(1, len(SEGMENTS) + 1) // len(SEGMENTS)
    return (total <= budgets).all(axis=1)


def _spanning(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within MAX_DISTANCE in one large run, by breadth-first search: fewer links than members."""
    rest, a, b = np.unique(f), [], []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            x, front = front[0], front[1:]
            near = np.bitwise_count(rest ^ x) <= MAX_DISTANCE
            if near.any():
                found, rest = rest[near], rest[~near]
                a.append(np.full(len(found), x)), b.append(found)
                front = np.concatenate([front, found])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a) if a else none), (np.concatenate(b) if b else none)


def _link_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, own first: links of each run of a key; a run that a batch cuts is carried on."""
    carry_k, carry_o, carry_f = np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64)

    def links(k: np.ndarray, o: np.ndarray, f: np.ndarray) -> Iterator[pd.DataFrame]:
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.concatenate([start, [len(k)]]))
        own = np.add.reduceat(o.astype(np.int64), start)
        big = own * size > PAIRS_IN_RUN
        for s, n in zip(start[big], size[big], strict=True):
            a, b = _spanning(f[s : s + n])
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
        some = (own > 0) & (size > 1) & ~big
        s, n, m = start[some], size[some], own[some]
        first = np.repeat(s, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)  # own rows come first in a run
        left = np.repeat(s + n, m) - first - 1
        for at in range(0, len(first), 20_000):
            p, c = first[at : at + 20_000], left[at : at + 20_000]
            i = np.repeat(p, c)
            j = i + 1 + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            ok = chains_fit(f[i] ^ f[j], k[i] >> 26) & (f[i] != f[j])
            yield pd.DataFrame({"a": f[i[ok]].view(np.int64), "b": f[j[ok]].view(np.int64)})

    for pdf in batches:
        k = np.concatenate([carry_k, pdf["key"].to_numpy(np.int64)])
        o = np.concatenate([carry_o, pdf["own"].to_numpy(np.int8)])
        f = np.concatenate([carry_f, pdf["fp"].to_numpy(np.int64).view(np.uint64)])
        if not len(k):
            continue
        cut = np.searchsorted(k, k[-1])
        carry_k, carry_o, carry_f = k[cut:], o[cut:], f[cut:]
        if cut:
            yield from links(k[:cut], o[:cut], f[:cut])
    if len(carry_k):
        yield from links(carry_k, carry_o, carry_f)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints, column ``fp``, at most MAX_DISTANCE bits apart.

    Every such pair is linked in one run or joined by links of a run: no component is lost.
    """
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # a fingerprint becomes 69 keyed rows, so the few bytes of distinct ones are dealt to all tasks first
    keyed = fps.select("fp").repartition(n, "fp").distinct().mapInPandas(_keys, "key long, own byte, fp long")
    dealt = keyed.repartition(n, "key").sortWithinPartitions("key", F.desc("own"))
    return dealt.mapInPandas(_link_runs, "a long, b long").distinct()


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, label): ``nodes`` is (fp, label) with each node's own label; the smallest label reachable, nulls last.

    Each round takes the smallest label of the neighbours and then jumps to the label that the
    labelling node has by now; rounds are written to the shared folder and end when nothing changes.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    linked = nodes.join(both.select(F.col("a").alias("fp")).distinct(), "fp", "left_semi")
    now = materialise(linked.select("fp", F.col("fp").alias("root"), F.struct(F.col("label").isNull().alias("none"), "label", "fp").alias("best")), "labels")
    n = 0
    while True:
        n += 1
        near = both.join(now.select(F.col("fp").alias("b"), "best"), "b").groupBy("a").agg(F.min("best").alias("near"))
        step = now.join(near.withColumnRenamed("a", "fp"), "fp").select("fp", F.col("best").alias("was"), F.least("best", "near").alias("best"))
        step = materialise(step, f"labels-{n}a")
        jump = step.select(F.col("fp").alias("via"), F.col("best").alias("far"))
        after = step.join(jump, F.col("best.fp") == F.col("via"), "left").select(
            "fp", "was", F.least("best", F.coalesce("far", "best")).alias("best")
        )
        after = materialise(after, f"labels-{n}b")
        if after.where(F.col("was") != F.col("best")).isEmpty():
            break
        now = after.select("fp", "best")
    found = now.select("fp", F.col("best.label").alias("label"))
    return nodes.join(both.select(F.col("a").alias("fp")).distinct(), "fp", "left_anti").select("fp", "label").unionByName(found)


def near_duplicates(docs: DataFrame, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null and wordless texts have fingerprint zero and are linked like any other; fewer words
    than a shingle make one shingle. component_id is the smallest doc_id of the component; null
    ids count only where there is no other. Repeated rows share all values; extra columns are
    not carried.
    """
    bounded_batches(docs.sparkSession)
    rows = materialise(
        docs.select(F.col(doc_id).alias("doc_id"), fingerprint_udf(shingle)(F.encode(F.col(text), "UTF-8")).alias("fp")), "fingerprints"
    )
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("label")), "distinct-fingerprints")
    found = components(fingerprint_links(nodes), nodes)
    return rows.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("label").alias("component_id")
    )


def keep_one(docs: DataFrame, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, all columns.

    Rows that share that id are one document: one of them stays. Rows with null ids stay only
    in components without any id, one of them.
    """
    groups = near_duplicates(docs, shingle, doc_id, text)
    keep = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("keep_doc_id"))
    counted = keep.groupBy("keep_doc_id").count()
    kept = docs.join(counted.select("keep_doc_id"), F.col(doc_id).eqNullSafe(F.col("keep_doc_id")), "left_semi")
    return kept if counted.where("count > 1").isEmpty() else kept.dropDuplicates([doc_id])
