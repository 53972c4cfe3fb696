"""Benchmark decontamination: BM25 over test items with block-max WAND, then an overlap check.

Test items are cut into pieces no longer than a passage and indexed as postings of BM25 weights,
scaled so that a piece scores 1 against its own words; document frequencies and the mean length
are those of all pieces, counted in Spark. Pieces are ordered by length and put into blocks. Every
passage of every document is a query: its terms' cursors stand on blocks in order; the pivot is
the first block at which the largest weights that are still to come could reach the threshold;
cursors behind it skip to it, its block maxima are summed, and only if these reach the threshold
are its pieces scored. Many passages move their cursors together. Retrieved items are verified on
the terms of the document around the passage: shingles of the item, its question and its answer.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, give_back, materialise

K1, B = 1.2, 0.75
#: Words of a half passage: a passage is two halves, and passages overlap by one.
HALF = 32
#: Pieces of an item, at most so many words; pieces of a block.
PIECE_WORDS, BLOCK_PIECES = 48, 16
#: Postings that are broadcast together, about; more make groups of items, each a further pass with the same weights.
GROUP_POSTINGS = 4_000_000
#: Share of a piece's own score that retrieves it; overlap that verifies an item; words of a shingle.
RETRIEVE, VERIFY, SHINGLE = 0.5, 0.8, 5
#: Passages whose cursors move together; words that a Python worker remembers before it starts anew.
TOGETHER, CACHE_WORDS = 4096, 1_000_000

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def term(word: str) -> str:
    """A word as compared: lower case, without signs at its ends; signs alone give the empty term, which is skipped."""
    return _EDGE.sub("", word.lower())


def terms(text: str) -> list[str]:
    return [t for w in text.split() if (t := term(w))]


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """(terms of all but the last sentence, terms of the last); a single sentence is both."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+", text.strip()) if terms(p)]
    if len(parts) < 2:
        return terms(text), terms(text)
    return terms(" ".join(parts[:-1])), terms(parts[-1])


def _shingles(t: list) -> set:
    return {tuple(t[i : i + SHINGLE]) for i in range(len(t) - SHINGLE + 1)} if len(t) >= SHINGLE else {tuple(t)}


@dataclass
class Index:
    """Postings of a group of items by term and piece, and of terms by block; a piece's number orders pieces by length."""

    names: list
    items: list[tuple[list[int], list[int], list[int]]] = field(repr=False)  # term numbers of the item, its question, its answer
    vocab: dict[str, int] = field(repr=False)
    piece_item: np.ndarray
    piece: np.ndarray
    x: np.ndarray
    #: Of each (term, block): term * (blocks + 1) + block, the first posting, the largest weight, and the largest from here on.
    key: np.ndarray
    first: np.ndarray
    top: np.ndarray
    rest: np.ndarray
    block: np.ndarray
    #: The first (term, block) of each term.
    begin: np.ndarray
    blocks: int

    @classmethod
    def of(cls, items: pd.DataFrame, postings: pd.DataFrame) -> Index:
        """items: item, name, words, question, answer; postings: item, piece, size, term, x."""
        items = items.sort_values("item")
        words = sorted(set(postings["term"]))
        vocab = {w: i for i, w in enumerate(words)}
        place = {item: n for n, item in enumerate(items["item"])}
        numbers = lambda ws: [vocab[w] for w in ws]
        kept = [tuple(numbers(r) for r in row) for row in zip(items["words"], items["question"], items["answer"], strict=True)]
        pieces = postings[["size", "item", "piece"]].drop_duplicates().sort_values(["size", "item", "piece"])
        pieces["number"] = np.arange(len(pieces))
        rows = postings.merge(pieces, on=["size", "item", "piece"])
        t, p, x = np.array([vocab[w] for w in rows["term"]], np.int64), rows["number"].to_numpy(), rows["x"].to_numpy(float)
        order = np.lexsort((p, t))
        t, p, x = t[order], p[order], x[order]
        blocks = max(1, -(-len(pieces) // BLOCK_PIECES))
        key, first = np.unique(t * (blocks + 1) + p // BLOCK_PIECES, return_index=True)
        top = np.maximum.reduceat(x, first) if len(x) else np.zeros(0)
        owner = key // (blocks + 1)
        rest = top.copy()
        for i in range(len(rest) - 2, -1, -1):
            if owner[i] == owner[i + 1]:
                rest[i] = max(rest[i], rest[i + 1])
        return cls(
            items["name"].tolist(), kept, vocab, np.array([place[i] for i in pieces["item"]], np.int64), p, x, key, np.append(first, len(x)), np.append(top, 0.0),
            np.append(rest, 0.0), np.append(key % (blocks + 1), blocks).astype(np.int32), np.searchsorted(owner, np.arange(len(vocab) + 1)), blocks,
        )

    def passages(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first half, start, end) of all passages; ids: term numbers of all documents in order, counts: terms of each."""
        halves = -(-counts // HALF)
        ends = np.cumsum(counts)
        doc = np.repeat(np.arange(len(counts)), halves)
        half = np.arange(halves.sum()) - np.repeat(np.cumsum(halves) - halves, halves)
        start = (ends - counts)[doc] + half * HALF
        return doc, half, start, np.minimum(start + 2 * HALF, ends[doc])

    def retrieve(self, ids: np.ndarray, counts: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(document, passage's first half, item, score) for all passages and pieces at or above the threshold.

        ids: term numbers of all documents in order, len(vocab) for terms that no item has.
        """
        doc, half, start, end = self.passages(ids, counts)
        for at in range(0, len(doc), TOGETHER):
            part = slice(at, at + TOGETHER)
            n = end[part] - start[part]
            t = ids[np.arange(n.sum()) + np.repeat(start[part] - (np.cumsum(n) - n), n)]
            owner = np.repeat(np.arange(len(n)), n)
            known = t < len(self.vocab)
            pair = np.unique(owner[known] * len(self.vocab) + t[known])  # a passage's distinct terms
            for row, piece, score in self._wand(pair // len(self.vocab), pair % len(self.vocab), threshold):
                yield int(doc[at + row]), int(half[at + row]), int(self.piece_item[piece]), score

    def _wand(self, owner: np.ndarray, t: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(passage, piece, score) for passages given as sorted (owner, term) pairs."""
        if not len(owner):
            return
        slack, none = threshold - 1e-9, len(self.key)
        rows, first, size = np.unique(owner, return_index=True, return_counts=True)
        column = np.arange(len(owner)) - np.repeat(first, size)
        line = np.repeat(np.arange(len(rows)), size)
        at, over = np.full((len(rows), size.max()), none), np.full((len(rows), size.max()), none)  # cursors, and where their terms end
        at[line, column], over[line, column] = self.begin[t], self.begin[t + 1]
        owned = np.zeros_like(at)
        owned[line, column] = t * (self.blocks + 1)
        while len(rows):
            block, bound = self.block[at], self.rest[at]
            order = np.argsort(block, axis=1)
            could = np.cumsum(np.take_along_axis(bound, order, 1), axis=1)
            live = could[:, -1] >= slack
            if not live.all():
                rows, at, over, owned, block, order, could = (a[live] for a in (rows, at, over, owned, block, order, could))
                if not len(rows):
                    break
            pivot = np.take_along_axis(order, (could >= slack).argmax(axis=1)[:, None], 1)
            pivot = np.take_along_axis(block, pivot, 1)
            behind = np.nonzero(block < pivot)
            if len(behind[0]):  # skip to the pivot's block, or to the one after it
                to = np.searchsorted(self.key, owned[behind] + pivot[behind[0], 0])
                at[behind] = np.where(to < over[behind], to, none)
                block[behind] = self.block[at[behind]]
            here = block == pivot
            sums = np.where(here, self.top[at], 0.0).sum(axis=1)
            hit = np.flatnonzero(sums >= slack)
            if len(hit):
                yield from self._score(rows[hit], at[hit], here[hit], threshold)
            at[here] += 1
            at[at >= over] = none

    def _score(self, rows: np.ndarray, at: np.ndarray, here: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """Full scores of the pieces of one block for each passage."""
        line, _ = np.nonzero(here)
        entry = at[here]
        n = self.first[entry + 1] - self.first[entry]
        p = np.arange(n.sum()) + np.repeat(self.first[entry] - (np.cumsum(n) - n), n)
        pair, where = np.unique(np.repeat(line, n) * len(self.piece_item) + self.piece[p], return_inverse=True)
        score = np.bincount(where, self.x[p])
        for i in np.flatnonzero(score >= threshold):
            yield int(rows[pair[i] // len(self.piece_item)]), int(pair[i] % len(self.piece_item)), float(score[i])

    def overlaps(self, words: np.ndarray, half: int, item: int) -> tuple[float, float, float]:
        """(item, question, answer) overlap with the document's terms around a passage, as far as an item could reach."""
        own, q, a = self.items[item]
        near = words[max(0, half * HALF - len(own)) : (half + 2) * HALF + len(own)].tolist()
        have, bag = _shingles(near), Counter(near)
        if len(own) < SHINGLE:  # too short for shingles: all its words in order
            n = len(own)
            found = float(any(near[i : i + n] == own for i in range(len(near) - n + 1)))
            return found, found, found
        part = lambda s: len(s & have) / len(s)
        question = part(_shingles(q)) if len(q) >= SHINGLE else sum((Counter(q) & bag).values()) / len(q)
        return part(_shingles(own)), question, sum((Counter(a) & bag).values()) / len(a)


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", group_postings: int = GROUP_POSTINGS) -> Iterator[Index]:
    """The index in groups of items of bounded size, one at a time on the driver; null ids and texts are skipped.

    Frequencies, mean length and weights come from all pieces, so an item's scores don't depend on its group.
    """
    rows = benchmark.select(F.col(item_id).alias("name"), F.col(text).alias("t")).where("name is not null and t is not null").distinct()
    rows = materialise(rows.withColumn("item", F.monotonically_increasing_id()), "test-items")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for item, t in zip(pdf["item"], pdf["t"], strict=True):
                words = terms(t)
                n = math.ceil(len(words) / PIECE_WORDS)
                size = math.ceil(len(words) / n) if n else 1
                for piece, at in enumerate(range(0, len(words), size)):
                    own = words[at : at + size]
                    out += [(item, piece, len(own), w, c) for w, c in Counter(own).items()]
            yield pd.DataFrame(out, columns=["item", "piece", "size", "term", "tf"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [question_answer(t) for t in pdf["t"]]
            yield pdf[["item", "name"]].assign(words=[terms(t) for t in pdf["t"]], question=[q for q, _ in both], answer=[a for _, a in both])

    tf = materialise(rows.select("item", "t").mapInPandas(cut, "item long, piece int, size int, term string, tf int"), "test-terms")
    pieces = tf.select("item", "piece", "size").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))
    seen = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = tf.join(seen, "term").crossJoin(F.broadcast(pieces))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    raw = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    w = materialise(w.select("item", "piece", "size", "term", raw.alias("raw")), "test-weights")
    own = w.groupBy("item", "piece").agg(F.sum("raw").alias("own"))
    total = w.count()
    group = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-total // group_postings)))).cast("int")
    postings = materialise(w.join(own, ["item", "piece"]).select(group.alias("g"), "item", "piece", "size", "term", (F.col("raw") / F.col("own")).alias("x")), "test-postings")
    name = rows.schema["name"].dataType.simpleString()
    whole = rows.mapInPandas(split, f"item long, name {name}, words array<string>, question array<string>, answer array<string>")
    whole = materialise(whole.where(F.size("words") > 0).select(group.alias("g"), "*"), "test-words")
    for g in range(max(1, -(-total // group_postings))):
        part = postings.where(F.col("g") == g).drop("g").toArrow().to_pandas()  # about group_postings rows
        if len(part):
            yield Index.of(whole.where(F.col("g") == g).drop("g").toArrow().to_pandas(), part)


def term_numbers(known: dict[str, int], vocab: dict[str, int], texts) -> tuple[np.ndarray, np.ndarray]:
    """(term numbers of an Arrow array of texts, terms of each); words of signs alone are left out. ``known`` remembers words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    coded, counts = parts.flatten().dictionary_encode(), np.diff(parts.offsets.to_numpy())
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    numbers = np.empty(len(names), np.int64)
    for n, w in enumerate(names):
        i = known.get(w)
        if i is None:
            x = term(w)
            i = known[w] = vocab.get(x, len(vocab)) if x else -1
        numbers[n] = i
    ids = numbers[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    is_term = ids >= 0
    return ids[is_term], np.bincount(doc[is_term], minlength=len(counts))


def _search_udf(sent, kind: str, retrieve: float, verify: float):
    """UDF: text -> the group's items found in it, by id."""

    @F.pandas_udf(f"array<struct<item_id:{kind},score:double,overlap:double,question_overlap:double,answer_overlap:double>>")
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import pyarrow as pa

        index, known = sent.value, {}
        columns = ("item_id", "score", "overlap", "question_overlap", "answer_overlap")
        for s in texts:
            if len(known) > CACHE_WORDS:
                known.clear()
            ids, counts = term_numbers(known, index.vocab, pa.array(s, pa.string(), from_pandas=True))
            ends = np.cumsum(counts)
            seen: dict[tuple[int, int, int], float] = {}
            for d, h, item, score in index.retrieve(ids, counts, retrieve):
                seen[d, h, item] = max(score, seen.get((d, h, item), 0.0))
            found: dict[int, dict] = {}
            for (d, h, item), score in sorted(seen.items()):
                o, q, a = index.overlaps(ids[ends[d] - counts[d] : ends[d]], h, item)
                if o >= verify or (q >= verify and a >= verify):
                    row, own = (index.names[item], min(1.0, score), o, q, a), found.setdefault(d, {})
                    own[row[0]] = max(row, own.get(row[0], row), key=lambda r: (r[2], r[1]))
            yield pd.Series([[dict(zip(columns, r, strict=True)) for _, r in sorted(found.get(d, {}).items())] for d in range(len(counts))], dtype=object)
        known.clear()
        give_back()

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame, retrieve: float = RETRIEVE, verify: float = VERIFY,
                 doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", group_postings: int = GROUP_POSTINGS) -> DataFrame:
    """One row for each row of ``docs`` and item found in it: doc_id, item_id, score, overlap, question_overlap, answer_overlap.

    An item is found if ``verify`` of its shingles stand around a retrieved passage, or if
    ``verify`` of its question's shingles and of its answer's words do. Null and empty texts
    hold nothing; repeated rows are each reported; items without a term are never found; of
    items that share an id each text counts, the best is reported. Extra columns aren't carried.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out, kind = None, benchmark.schema[item_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    for index in indexes(benchmark, item_id, group_postings=group_postings):
        search = _search_udf(spark.sparkContext.broadcast(index), kind, retrieve, verify)
        found = rows.select("doc_id", F.explode(search("text")).alias("m")).select("doc_id", "m.*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = f"item_id {kind}, score double, overlap double, question_overlap double, answer_overlap double"
        return rows.select("doc_id").where("false").join(spark.createDataFrame([], kind))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns; each row is judged by its own text."""
    bounded_batches(docs.sparkSession)
    out, own = docs, fresh(docs, "found_items")
    for index in indexes(benchmark, item_id):
        search = _search_udf(docs.sparkSession.sparkContext.broadcast(index), benchmark.schema[item_id].dataType.simpleString(), RETRIEVE, VERIFY)
        out = out.withColumn(own, search(F.col(text))).where(F.size(own) == 0).drop(own)
    return out
