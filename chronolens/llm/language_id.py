"""Language identification: each document is a mixture of languages.

Words are drawn from languages with likelihoods from character n-grams. Expectation
maximisation finds a document's proportions; languages leave the set, smallest share first,
while the likelihood with a penalty for each language doesn't fall.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, give_back

#: The classifier is fitted on about so many labelled documents of each language (chosen by a hash of the text).
DOCS_PER_LANGUAGE = 4000
#: Hashed n-grams; lengths of n-grams; languages that a model may have.
BUCKETS, LENGTHS, MAX_LANGUAGES = 1 << 15, (1, 2, 3), 200
#: EM rounds for each set of languages.
ROUNDS = 8
UNKNOWN = "und"
#: Words that a Python worker remembers before it starts anew.
CACHE_WORDS = 400_000

_LETTERS = re.compile(r"[^\W\d_]+")


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams that start at each place of the words, written one after the other with a space before each.

    Returns buckets [LENGTHS, places] (-1: the n-gram would leave its word; a space at either
    end is part of it), each place's word, and the place where each word starts.
    """
    text = " " + " ".join(words) + " "
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n, space = len(c) - 1, c == 32
    out = np.full((len(LENGTHS), n), -1, np.int64)
    h = np.full(n, 7, np.uint64)
    for k in range(max(LENGTHS)):
        h[: n - k] = (h[: n - k] * np.uint64(31337) + c[k : n] * np.uint64(7919) + np.uint64(1)) & np.uint64(0xFFFFFFFF)
        m = n - k  # n-grams of k + 1 letters that end before the closing space are whole
        if k + 1 in LENGTHS:
            inside = ~space[:m] if k == 0 else np.ones(m, bool)
            for j in range(1, k):
                inside &= ~space[j : m + j]
            g = (h[:m] ^ (h[:m] >> np.uint64(15))) % np.uint64(BUCKETS)
            out[LENGTHS.index(k + 1), :m] = np.where(inside, g.astype(np.int64), -1)
    starts = np.flatnonzero(space[:n])
    return out, np.cumsum(space[:n]) - 1, starts


@dataclass
class Model:
    """Learned languages in order, and the log likelihood of each n-gram bucket in each: [BUCKETS, languages]."""

    languages: list[str]
    log_p: np.ndarray


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Learn from the rows of ``docs`` with text and language; rows with a null in either teach nothing.

    Rows of a language beyond ``docs_per_language`` are drawn by a hash of id and text, so that copies
    of a text are drawn each for itself; the row with the smallest hash is always among them. Without
    a column ``doc_id`` copies of a text share their draw.

    An empty table gives a model without languages, which answers ``und``. More than MAX_LANGUAGES
    languages are an error: the model, which every worker holds, has BUCKETS numbers for each.
    """
    bounded_batches(docs.sparkSession)
    draw = F.xxhash64(*([doc_id] if doc_id in docs.columns else []), text, F.lit("sample")).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), draw.alias("draw")).where("text is not null and lang is not null")
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")).limit(MAX_LANGUAGES + 1).collect()
    counts = {r["lang"]: r["n"] for r in found}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    share = {r["lang"]: max(min(1.0, docs_per_language / r["n"]), r["least"]) for r in found}
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(share[k]))])
    index = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(languages), BUCKETS + 1), np.int64)

        def add(seen: dict[str, Counter]) -> None:
            for k, words in seen.items():
                if words:
                    buckets, owner, _ = gram_buckets(list(words))
                    n = np.fromiter(words.values(), np.int64, len(words))[owner]
                    for b in buckets:
                        total[index[k]] += np.bincount(np.where(b < 0, BUCKETS, b), n, BUCKETS + 1).astype(np.int64)
            seen.clear()

        seen: dict[str, Counter] = defaultdict(Counter)
        for pdf in batches:
            for t, k in zip(pdf["text"], pdf["lang"], strict=True):
                seen[k].update(_LETTERS.findall(t.lower()))
            if sum(map(len, seen.values())) > CACHE_WORDS:
                add(seen)
        add(seen)
        for i in range(len(languages)):
            at = np.flatnonzero(total[i, :BUCKETS])
            if len(at):
                yield pd.DataFrame({"l": np.int32(i), "b": at, "n": total[i][at]})

    sample = rows.where(F.col("draw") <= share[F.col("lang")]).select("text", "lang")
    table = sample.mapInPandas(count, "l int, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    n = np.zeros((BUCKETS, len(languages)))
    for r in table.toLocalIterator():  # at most MAX_LANGUAGES * BUCKETS numbers
        n[r["b"], r["l"]] = r["n"]
    return Model(languages, np.log((n + 0.5) / (n.sum(0) + 0.5 * BUCKETS)))


def mixtures(p: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float = 1.0) -> np.ndarray:
    """Proportions [languages, n_docs] from word likelihoods p [languages, words]; ``doc``: each word's document, ascending.

    The penalty for a language is ``penalty + log(words) / 2``. Documents without words get zeros.
    """
    k = len(p)
    words = np.bincount(doc, minlength=n_docs).astype(np.float64)

    def em(mask: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.flatnonzero(which)
        if len(ids) < n_docs:
            at = np.flatnonzero(which[doc])
            q, size = p[:, at], words[ids].astype(np.int64)
        else:
            q, size = p, words.astype(np.int64)
        cut, n = np.cumsum(size) - size, size.astype(np.float32)
        share = (mask[:, ids] / mask[:, ids].sum(0)).astype(np.float32)
        for r in range(ROUNDS + 1):
            parts = np.repeat(share, size, axis=1)
            parts *= q
            total = np.maximum(parts.sum(0), np.float32(1e-30))
            if r == ROUNDS:
                break
            parts /= total
            share = np.add.reduceat(parts, cut, axis=1) / n
        pi, ll = np.zeros((k, n_docs)), np.full(n_docs, -np.inf)
        pi[:, ids] = share
        ll[ids] = np.add.reduceat(np.log(total).astype(np.float64), cut)
        return pi, ll

    active = words > 0
    if not active.any() or not k:
        return np.zeros((k, n_docs))
    mask = np.ones((k, n_docs))
    pi, ll = em(mask, active)
    cost = penalty + 0.5 * np.log(np.maximum(words, 1))
    for _ in range(k - 1):
        out = np.where(mask > 0, pi, np.inf).argmin(0)
        trial = mask.copy()
        trial[out, np.arange(n_docs)] = 0
        active &= trial.sum(0) > 0
        if not active.any():
            break
        new_pi, new_ll = em(trial, active)
        active = active & (new_ll + cost >= ll)
        mask[:, active], pi[:, active], ll[active] = trial[:, active], new_pi[:, active], new_ll[active]
    return pi


class _Words(dict):
    """Word -> column of its likelihoods; grows by what is looked up."""

    def __init__(self, log_p: np.ndarray):
        super().__init__()
        self.log_p, self.new, self.table = log_p.astype(np.float32), [], np.zeros((log_p.shape[1], 0), np.float32)

    def __missing__(self, w: str) -> int:
        self.new.append(w)
        self[w] = n = len(self)
        return n

    def likelihoods(self) -> np.ndarray:
        """[languages, words] relative to the likeliest language; the words new since the last call are worked out together."""
        if self.new:
            buckets, _, starts = gram_buckets(self.new)
            padded = np.vstack([self.log_p, np.zeros((1, self.log_p.shape[1]), np.float32)])
            sums = sum(np.add.reduceat(padded[b], starts, axis=0) for b in buckets)
            rel = np.exp(np.maximum(sums - sums.max(1, keepdims=True), -60))
            self.table = np.concatenate([self.table, rel.T.astype(np.float32)], axis=1)
            self.new.clear()
        return self.table


def predict(model: Model, text: Column) -> Column:
    """A struct column: lang_pred, score (its share, 0 to 1), shares (language -> share of those in the set).

    Null texts and texts without a letter give ``und``, score 0 and no shares.
    """
    languages, log_p = model.languages, model.log_p
    spark_type = "lang_pred string, score double, shares map<string,double>"

    @F.pandas_udf(spark_type)
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, find = _Words(log_p), _LETTERS.findall
        for s in texts:
            if len(words) > CACHE_WORDS:
                words = _Words(log_p)
            ids, sizes = [], []
            for t in s:
                before = len(ids)
                if t is not None and languages:
                    found = find(t.lower())
                    if found and not found[0].isalpha():  # signs such as a raised 2: only words with a letter count
                        found = [w for w in found if any(map(str.isalpha, w))]
                    ids.extend(map(words.__getitem__, found))
                sizes.append(len(ids) - before)
            pi = mixtures(words.likelihoods()[:, ids], np.repeat(np.arange(len(s)), sizes), len(s)) if languages else np.zeros((0, len(s)))
            best = pi.argmax(0) if languages else np.zeros(len(s), int)
            known = pi.sum(0) > 0
            yield pd.DataFrame(
                {
                    "lang_pred": [languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)],
                    "score": [float(min(1.0, pi[b, i])) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))],
                    "shares": [{languages[j]: float(min(1.0, r[j])) for j in np.flatnonzero(r > 0)} for r in pi.T],
                }
            )
        del words
        give_back()

    return predicted(text)


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with the struct of :func:`predict` in a column ``out``, or ``out`` with a number where ``docs`` has that name."""
    bounded_batches(docs.sparkSession)
    return docs.select("*", predict(model, F.col(text)).alias(fresh(docs, out)))
