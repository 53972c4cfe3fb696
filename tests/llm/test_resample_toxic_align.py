"""Importance resampling, toxic passages and token alignment against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.llm import alignment, queries, resampling, toxicity
from chronolens.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def docs(spark):
    """The small table and the odd rows: null and empty texts, null ids, repeats, ties, a very long text, clashing extra columns."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"wörd{i % 977}" for i in range(20000))
    odd = [(9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, long, "en", None, 1), (9004, long, "en", "src1", 1), (9005, "a\n\na\n", "en", "src2", 6), (9005, "a\n\na\n", "en", "src2", 6),
           (None, "x y", "en", "src3", 3), (9006, " \t ", None, "src3", 3), (9007, "a  b  c <|endoftext|> <s> x▁y", "en", "s", 1), (9008, "日本語 テキスト\n è\x00 🙂 ", "ja", "s", 1), (9009, "n" * 50000, "en", "s", 1)]
    return base.unionByName(spark.createDataFrame(odd, SCHEMA)).withColumn("score", F.lit(1)).withColumn("RANK", F.lit("k")).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def features(text):
    w = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode())
    return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("head", ["usual", "none", "everything"])
def test_resampling(spark, docs, rows, empty, head, monkeypatch):
    if head == "none":
        monkeypatch.setattr(resampling, "HEAD_WORDS", 0)
    if head == "everything":
        monkeypatch.setattr(resampling, "HEAD_SHARE", 0)
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for r in target.collect():
        t.update(features(r["text"])[1])
    S, T = sum(s.values()), sum(t.values())
    want, able = Counter(), []
    for i, text in rows:
        n, f = features(text)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want[i, len(f), w, score] += 1
        if n >= 20:
            able.append((-score, i))
    got = resampling.resample(docs, target).collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == want
    drawn = sorted((r["rank"], r["doc_id"]) for r in got if r["rank"] is not None)
    assert drawn == [(k + 1, i) for k, (_, i) in enumerate(sorted(able)[: 5 * len(able) // 100])] and drawn
    assert resampling.resample(empty, target).count() == 0
    assert resampling.resample(docs, target.limit(0)).where("rank is not null").count() == len(drawn)


def test_states_are_carried_over():
    rng = random.Random(3)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(40)), rng.randbytes(rng.randrange(1, 300))
        got = resampling.carry(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]), np.array([zlib.crc32(b)], np.uint32))
        assert int(got[0]) == zlib.crc32(a + b)


def best_segments(x):
    """All maximal segments by their definition: the best segment, then those left and right of it."""
    best = max(((sum(x[i:j]), -(j - i), -i) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[2], -best[2] - best[1]
    return best_segments(x[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in best_segments(x[j:])]


def test_maximal_segments():
    rng = random.Random(5)
    for _ in range(400):
        x = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 64 for _ in range(rng.randrange(14))]
        got, want = toxicity.maximal_segments(np.array(x)), best_segments(x)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_words_and_slots():
    slot, text, start, end = toxicity.tokens(["Ünd und, x1Y", "", "ÜND\nY idiot***"])
    words = [(["Ünd und, x1Y", "", "ÜND\nY idiot***"][t][a:b]).lower() for t, a, b in zip(text, start, end, strict=True)]
    assert words == ["ünd", "und", "x", "y", "ünd", "y", "idiot"]
    assert slot[0] == slot[4] and slot[3] == slot[5] and len(set(slot.tolist())) == 5


def toxic_corpus(spark, n=1500):
    """Made-up prose; one text in eight is labelled toxic and has bad words close together, bar some labels that are wrong."""
    rng = random.Random(11)
    words = ["".join(rng.choice(["ba", "ko", "ri", "tu", "sen", "lo"]) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(30, 300))]
        toxic = rng.random() < 0.125
        if toxic:
            k = rng.randrange(len(w) - 12)
            for j in range(0, 12, 3):
                w[k + j] = rng.choice(["Grubnak", "zzarf!", "vexoid"])
        texts.append((i, " ".join(w)))
        labels.append((i, int(toxic ^ (rng.random() < 0.03))))
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_corpus(spark)
    odd = spark.createDataFrame([(7001, None), (7002, ""), (None, "grubnak zzarf vexoid"), (7003, "zzarf"), (7003, "zzarf"), (7004, "kori " * 200000 + "grubnak zzarf vexoid")], "doc_id long, text string")
    every = docs.unionByName(odd).withColumn("toxic", F.lit("x")).withColumn("score", F.lit(0))
    held = F.col("doc_id") % 5 == 0
    model = toxicity.fit(every, labels, ~held)
    got = toxicity.score(every, model).collect()
    assert len(got) == 1506 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    right = hits = 0
    for r in got:
        if r["doc_id"] in texts and r["doc_id"] % 5 == 0:
            bad = "vexoid" in texts[r["doc_id"]] or "zzarf" in texts[r["doc_id"]] or "Grubnak" in texts[r["doc_id"]]
            right += r["predicted"] == bad
            if bad:
                (p,) = r["passages"]
                words = re.findall("Grubnak|zzarf|vexoid", texts[r["doc_id"]][p["start"] : p["end"]])
                hits += len(words) == 4 and p["expected"] < toxicity.EXPECTED
    assert right >= 298 and hits >= 30
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    assert by_id[7001][0]["predicted"] == by_id[7002][0]["predicted"] == 0 and len(by_id[7003]) == 2
    assert by_id[None][0]["predicted"] == 1 and by_id[7004][0]["passages"][0]["start"] == 1000000
    # the tail: chances of the weights sum to one at its root
    slots = toxicity._slot_counts(docs.withColumn("toxic", F.lit(None).cast("double")))
    assert slots.agg(F.sum("n")).first()[0] == sum(len(set(toxicity.tokens([t])[0].tolist())) for t in texts.values())
    # copies of the labelled texts count once, and without labels nothing is known
    twice = toxicity.fit(docs.unionByName(docs), labels, ~held)
    assert np.allclose(sorted(twice.weights), sorted(toxicity.fit(docs, labels, ~held).weights))
    none = toxicity.score(every, toxicity.fit(every, labels.limit(0), ~held))
    assert none.where("score = 0 and predicted = 0").count() == 1506
    assert toxicity.score(every.limit(0), model).count() == 0
    assert toxicity.fit(every.limit(0), labels, ~held).base == 0


def test_labelled_bound(spark):
    docs, labels = toxic_corpus(spark, 600)
    chosen = toxicity._labels(docs, labels, F.lit(True), 100)
    assert 50 <= chosen.count() <= 100


def test_toxicity_on_the_table(spark):
    got = queries.QUERIES["op12_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    assert (held["predicted"] == held["toxic"]).mean() > 0.9


def test_common_ends():
    rng = random.Random(1)
    for _ in range(2000):
        n = rng.randrange(1, 60)
        base = sorted(rng.sample(range(1, 99), n))
        x, y = (sorted({b for b in base if rng.random() < p} | {99}) for p in (rng.random(), rng.random()))
        at_x, at_y = alignment.align(x, y)
        both = sorted(set(x) & set(y))
        assert [x[i] for i in at_x] == both == [y[i] for i in at_y]
    assert alignment.align([], []) == ([], [])


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(tokenizer_path(A))
    ta.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))
    letter = alignment._byte_of_letter()
    spell_a = {i: bytes(letter[c] for c in t) for t, i in ta.get_vocab().items() if i != 50256}
    done, count = [], Counter()
    for i, text in rows:
        want, groups, links = f" {text}".encode(), [], []
        a = ta.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        of_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        of_a = [spell_a[x] for x in a]
        if not text or b"".join(of_a) != want or b"".join(of_b) != want:
            done.append((i, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, of_a))).tolist(), np.cumsum(list(map(len, of_b))).tolist()
        p = q = 0
        for e in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(e, p), ends_b.index(e, q)
            groups.append(f"{','.join(map(str, a[p : x + 1]))}|{','.join(map(str, b[q : y + 1]))}")
            links.append((a[x], b[y]))
            p, q = x + 1, y + 1
        count.update(links)
        done.append((i, a, b, groups, links))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return Counter((i, len(a), len(b), len(g), len(k), sum(count[x] == top[x[1]] for x in k), sum(count[x] for x in k), ";".join(g)) for i, a, b, g, k in done), count


def test_alignment(docs, rows, empty):
    want, count = brute_alignment(rows)
    names = (tokenizer_path(A), tokenizer_path(B))
    assert Counter(tuple(r) for r in alignment.align_tokenizers(docs, *names).collect()) == want
    # more pairs than a pass takes: the same by several passes
    assert Counter(tuple(r) for r in alignment.align_tokenizers(docs, *names, pass_pairs=len(count) // 2).collect()) == want
    assert alignment.align_tokenizers(empty, *names).count() == 0


def test_alignment_of_whole_texts_and_small_memory(docs, rows, monkeypatch):
    want, _ = brute_alignment(rows)
    monkeypatch.setattr(alignment, "STRETCHES", 50)
    monkeypatch.setattr(alignment, "TOGETHER", 3)
    monkeypatch.setattr(alignment, "_memos", {})
    pair = alignment.Pair(tokenizer_path(A), tokenizer_path(B))
    for cut in (True, False):
        pair.cut = cut
        memo = alignment.Stretches(pair, (np.zeros(0, np.int64),) * 3)
        texts = Counter()
        for i, t in rows:
            x = alignment._numbered(memo, t)
            memo.settle()
            good = x and all(memo.ok[k] for k in x)
            texts[i, sum(memo.n_a[k] for k in x) if good else 0, ";".join(memo.text[k] for k in x) if good else ""] += 1
        assert texts == Counter({(w[0], w[1], w[7]): n for w, n in want.items()})


def test_stretches_keep_the_tokens():
    pair = alignment.Pair(tokenizer_path(A), tokenizer_path(B))
    assert pair.cut and pair.ranked
    rng = random.Random(2)
    bits = [" ", "  ", "\n", "a", "bc", "The", "ing", "é", "\t", "　", ".", "'s", "9", "\xa0", "日", "\x1c", "<s>", "<|endoftext|>", "don't"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 30)))
        parts = alignment.stretches(text)
        assert " ".join(parts) == text
        assert [i for p in parts for i in pair.ids_a(f" {p}")] == pair.a.encode(f" {text}", add_special_tokens=False).ids
        assert [i for p in pair.ids_b(parts) for i in p] == pair.b.encode(text)
