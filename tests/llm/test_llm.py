"""Training-data operators against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.llm import decontamination, exact_dedup, language_id, line_dedup, lm_scoring, mixing, pii, queries, simhash, token_output, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """The small table and the odd rows: null and empty texts, null ids, repeats, a long text, clashing extra columns."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"wörd{i % 977}" for i in range(9000))
    odd = [(9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, long, "en", None, 1), (9004, long, "en", "src1", 1), (9005, "a\n\na\n", "en", "src2", 6), (9005, "a\n\na\n", "en", "src2", 6), (None, "x y", "en", "src3", 3), (9006, " \t ", None, "src3", 3)]
    return base.unionByName(spark.createDataFrame(odd, SCHEMA)).withColumn("block", F.lit(1)).withColumn("KEY", F.lit("k")).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().lower().split()


def test_exact_duplicates(docs, rows, empty):
    for size in (16, 4096):
        got = sorted(exact_dedup.exact_duplicates(docs, block_bytes=size).collect(), key=str)
        groups = defaultdict(list)
        for i, t, _ in rows:
            groups[t or ""].append(i)
        assert len(got) == len(rows)
        want = Counter((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_repeated_lines(docs, rows, empty, monkeypatch):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    n = Counter()
    for _, t, _ in rows:
        n.update({key(x) for x in (t or "").split("\n")} - {""})
    got = line_dedup.repeated_lines(docs, min_docs=3).collect()
    want = Counter()
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < 3]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert Counter(tuple(r) for r in got) == want
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 2)
    assert Counter(tuple(r) for r in line_dedup.repeated_lines(docs, min_docs=3).collect()) == want
    first = line_dedup.repeated_lines(docs.where("doc_id < 9000"), min_docs=3, keep_first=True)
    assert first.agg(F.sum("n_dropped")).first()[0] < line_dedup.repeated_lines(docs.where("doc_id < 9000"), min_docs=3).agg(F.sum("n_dropped")).first()[0]
    assert line_dedup.repeated_lines(empty).count() == 0


def test_places_of_a_hash_lie_in_its_shard():
    h = np.random.default_rng(9).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)
    for bits in (1 << 20, 1 << 29, 1 << 31):
        at, size = line_dedup._places(h, bits), bits // line_dedup._shards(bits)
        assert at.max() < bits and (at // np.uint64(size) == line_dedup._shard(h, bits)[:, None]).all()
    assert line_dedup._shards(1 << 31) == 1024


def fingerprint(t, n=4):
    import xxhash

    w = words(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs, rows, empty):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    f = {i: fingerprint(t) for i, t, _ in rows}
    ids = [i for i in f if i is not None]
    root = {i: i for i in f}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in f:
        for b in f:
            if (f[a] ^ f[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                if x != y:
                    root[max((x, y), key=lambda v: (v is None, v or 0))] = min((x, y), key=lambda v: (v is None, v or 0))
    for i in ids:
        assert got[i]["fingerprint"] == f"{f[i]:016x}"
        assert got[i]["component_id"] == find(i)
    kept = simhash.keep_one(docs, 4)
    assert kept.columns == docs.columns and kept.count() == len({find(i) for i in f})
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 40)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 6), replace=False)) for c in centre for _ in range(12)]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(near))], "fp long, label long")
    got = dict(simhash.components(simhash.fingerprint_links(df), df).collect())
    nodes, label = list(got), {}
    for i, x in enumerate(dict.fromkeys(near)):
        label[x] = i
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if (a ^ b).bit_count() <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    assert got == label


def test_large_run_is_spanned():
    f = np.array([x for x in range(64)], np.uint64)
    a, b = simhash._spanning(f)
    assert len(a) == 63 and (np.bitwise_count(a ^ b) <= 4).all()


def test_url_filter(spark):
    urls = ["http://A.COM/en/1", "https://x.example.com/en/77?q", "nothing", None, "http://www.spam-farm.org/x/", "http://spam-farm.org/x#f", "http://z.org?a=/es/", "http://example.net/de/8", "ftp://net/de/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, b string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, url_filter.listed_on_sites(pages)).collect()}
    assert [got[i]["rule"] for i in range(9)] == ["com/en/", "example.com/en/7", None, None, None, None, None, "example.net/de/8", "net/de/"]
    assert [got[i]["verdict"] for i in range(9)] == ["block", "allow", "allow", "allow", "block", "block", "allow", "block", "allow"]
    assert got[0]["host"] == "a.com" and got[6]["path"] == "" and got[2]["host"] == ""
    none = spark.createDataFrame([], "canonical string")
    assert url_filter.judge_urls(pages, none).where("listed").count() == 0
    assert url_filter.judge_urls(pages.limit(0), none).count() == 0


def test_bloom_has_no_misses(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    got = url_filter.in_list(keys, "key", keys.where("key like '%7'"), "hit")
    assert got.where(F.col("hit") != F.col("key").like("%7")).count() == 0


def test_language_of_held_out_documents(docs, empty, spark):
    train = docs.where("doc_id % 5 <> 0 and doc_id < 9000")
    model = language_id.fit(train)
    out = language_id.identify(docs, model)
    got = out.where("doc_id % 5 = 0 and doc_id < 9000").select(F.avg((F.col("language.lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert got >= 0.9
    und = {r["doc_id"]: r["language"] for r in out.where("doc_id > 9000").collect()}
    assert und[9001]["lang_pred"] == und[9002]["lang_pred"] == und[9006]["lang_pred"] == "und" and und[9001]["score"] == 0
    assert language_id.identify(docs, language_id.fit(empty)).where("language.lang_pred <> 'und'").count() == 0
    signs = spark.createDataFrame([(1, "² ½ 12 _"), (2, "² der und die")], "doc_id long, text string")
    assert [r["language"]["lang_pred"] == "und" for r in language_id.identify(signs, model).orderBy("doc_id").collect()] == [True, False]


def mixture_by_hand(p, penalty=1.0):
    """Proportions of one document from word likelihoods p [languages, words]: EM in each set, the smallest share leaving."""
    n = len(p[0])

    def em(langs):
        share = {k: 1 / len(langs) for k in langs}
        for _ in range(language_id.ROUNDS):
            new = dict.fromkeys(langs, 0.0)
            for w in range(n):
                total = sum(share[k] * p[k][w] for k in langs)
                for k in langs:
                    new[k] += share[k] * p[k][w] / total / n
            share = new
        return share, sum(math.log(sum(share[k] * p[k][w] for k in langs)) for w in range(n))

    langs = list(range(len(p)))
    share, ll = em(langs)
    while len(langs) > 1:
        rest = [k for k in langs if k != min(langs, key=lambda k: share[k])]
        new, new_ll = em(rest)
        if new_ll + penalty + 0.5 * math.log(n) < ll:
            break
        langs, share, ll = rest, new, new_ll
    return [share.get(k, 0.0) for k in range(len(p))]


def test_mixtures_by_plain_loops():
    rng = np.random.default_rng(3)
    for seed in range(6):
        sizes = [40, 0, 3, 120]
        own = [rng.integers(0, 4, 2), [0], [1], rng.integers(0, 4, 3)]
        p, doc = [], []
        for d, n in enumerate(sizes):
            for _ in range(n):
                q = np.exp(-rng.exponential(4, 4))
                q[rng.choice(own[d])] = 1.0
                p.append(q), doc.append(d)
        p = np.array(p, np.float32).T
        got = language_id.mixtures(p, np.array(doc), len(sizes))
        assert (got[:, 1] == 0).all()
        for d in (0, 2, 3):
            assert np.allclose(got[:, d], mixture_by_hand(p[:, np.array(doc) == d].astype(float)), atol=2e-3), seed


def test_language_column_of_the_users_stays(docs):
    df = docs.limit(5).withColumn("Language", F.lit("mine"))
    out = language_id.identify(df, language_id.Model([], np.zeros((language_id.BUCKETS, 0))))
    assert out.columns == [*df.columns, "language_1"] and out.select("Language").distinct().first()[0] == "mine"


def test_contamination(spark, docs, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: [w for x in r["text"].split() if (w := decontamination.term(x))] for r in bench.collect()}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()}
    want = set()
    for r in docs.collect():
        w = [x for y in (r["text"] or "").split() if (x := decontamination.term(y))]
        have = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for k, t in items.items():
            s = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
            if len(s & have) >= 0.8 * len(s):
                want.add((r["doc_id"], k))
    assert got == want and want
    clean = decontamination.without_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.where(~F.coalesce(F.col("doc_id").isin([i for i, _ in want]), F.lit(False))).count()
    assert decontamination.contaminated(empty, bench).count() == decontamination.contaminated(docs, bench.limit(0)).count() == 0


def bm25_by_hand(items, passage):
    """{(item, piece): score} of all pieces, from the definition."""
    pieces = []
    for i, t in items:
        w = decontamination.terms(t)
        n = -(-len(w) // decontamination.PIECE_WORDS)
        size = -(-len(w) // n)
        pieces += [(i, w[k : k + size]) for k in range(0, len(w), size)]
    mean, n = np.mean([len(w) for _, w in pieces]), len(pieces)
    df = Counter(t for _, w in pieces for t in set(w))
    out = {}
    for k, (i, w) in enumerate(pieces):
        tf = Counter(w)
        raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, c in tf.items()}
        out[i, k] = sum(x for t, x in raw.items() if t in passage) / sum(raw.values())
    return out


def test_wand_retrieves_all_above_the_threshold(spark):
    rng = np.random.default_rng(5)
    item = lambda n: " ".join(f"w{x}" for x in rng.zipf(1.3, n) % 400)
    items = [(i, item(int(rng.integers(1, 120)))) for i in range(90)]
    table = spark.createDataFrame(items, "item_id long, text string")
    texts = [t + " " + item(20) for _, t in items[:20]] + ["", item(5), "w1"]
    w = [decontamination.terms(t) for t in texts]
    for threshold in (0.3, 0.5, 0.9):
        want = {}
        for d, ws in enumerate(w):
            for h in range(-(-len(ws) // 32)):
                for (i, _), s in bm25_by_hand(items, set(ws[h * 32 : h * 32 + 64])).items():
                    if s >= threshold:
                        want[d, h, i] = max(s, want.get((d, h, i), 0))
        for group in (10**6, 300):
            got, used = {}, 0
            for index in decontamination.indexes(table, group_postings=group):
                ids = np.array([index.vocab.get(x, len(index.vocab)) for ws in w for x in ws])
                for d, h, i, s in index.retrieve(ids, np.array([len(ws) for ws in w]), threshold):
                    got[d, h, index.names[i]] = max(s, got.get((d, h, index.names[i]), 0))
                used += 1
            assert got.keys() == want.keys() and len(want) > 20 and (group > 1000 or used > 3)
            assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_question_and_answer_are_found_apart(spark):
    question = "which of the seven quiet rivers below the northern hills was measured twice before the bridge fell"
    bench = spark.createDataFrame([("q1", question + "? The answer is the Tamblin river beside Orvane mill."), ("q2", "unrelated words entirely here now. Nothing more.")], "item_id string, text string")
    swapped = question + " and then someone said river Tamblin mill Orvane the beside answer is the"  # the answer's words in another order
    half = question + " and nobody ever knew what came of it in the end at all"
    docs = spark.createDataFrame([(1, swapped), (2, half), (3, None)], "doc_id long, text string")
    got = decontamination.contaminated(docs, bench, verify=0.75).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, "q1")]
    assert got[0]["overlap"] < 0.75 <= got[0]["question_overlap"] and got[0]["answer_overlap"] >= 0.75
    assert [r["doc_id"] for r in decontamination.without_contaminated(docs, bench).orderBy("doc_id").collect()] == [2, 3]


def test_matches_do_not_depend_on_groups(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    few = docs.where("doc_id < 300")
    rows = [sorted(decontamination.contaminated(few, bench, group_postings=n).collect()) for n in (10**7, 2000)]
    assert rows[0] and [r[:2] for r in rows[0]] == [r[:2] for r in rows[1]] and np.allclose([r[2:] for r in rows[0]], [r[2:] for r in rows[1]])


def test_token_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    file = queries.tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(file)
    extra = spark.createDataFrame([(9100, "It's <|endoftext|> 12th ÀÉ é K x y 日本 don't!!! <|ENDOFTEXT|>", None, None, 1)], SCHEMA)
    path = token_output.write_tokens(docs.select(*extra.columns).unionByName(extra), file)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_output.read_tokens(spark, path).collect())
    at = 0
    all_rows = [(i, t) for i, t, _ in rows] + [(9100, extra.first()["text"])]
    for (i, t), g in zip(sorted(all_rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert g == (at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    n = token_output.token_counts(spark, path, [2, 49407]).groupBy("token").agg(F.sum("n")).collect()
    assert dict((r[0], r[1]) for r in n)[2] >= len(all_rows)
    assert token_output.read_tokens(spark, token_output.write_tokens(empty, file)).count() == 0


def test_token_files_keep_long_ids_beside_a_null_one(spark):
    big = [2**53 + 1, 2**53 + 3, None, -5, 2**62]
    df = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(big)], "doc_id long, text string")
    path = token_output.write_tokens(df, queries.tokenizer_path("word_bpe_49k.json"))
    got = token_output.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, -5, 2**53 + 1, 2**53 + 3, 2**62]


def test_other_tokenizer_files_encode_whole_texts(tmp_path):
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(queries.tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "NFC"}
    file = str(tmp_path / "cased.json")
    with open(file, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    encoder = token_output.WordEncoder(file)
    assert not encoder.by_word and token_output.WordEncoder(queries.tokenizer_path("word_bpe_49k.json")).by_word
    ids, n = token_output.encode_texts(token_output._Words(encoder, 2), pa.array(["Some WORDS", ""]))
    want = Tokenizer.from_file(file).encode("Some WORDS", add_special_tokens=False).ids
    assert ids.tolist() == [*want, 2, 2] and n.tolist() == [len(want) + 1, 1]


def test_words_are_cut_as_the_tokenizer_cuts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    file = queries.tokenizer_path("word_bpe_49k.json")
    tok, words, rng = Tokenizer.from_file(file), token_output._Words(token_output.WordEncoder(file), 2), random.Random(1)
    alphabet = "abcXYZ é É ß ſ K 12 '’ .,!?<|>-_ 日本 \u0301 \x85\x1c\x0b Σς İ Ж ½ ² \x01 sdtremvll'S'D"
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        ids, n = token_output.encode_texts(words, pa.array([s, ""]))
        assert ids.tolist() == [*tok.encode(s, add_special_tokens=False).ids, 2, 2] and n.tolist() == [len(ids) - 1, 1]


def test_new_words_are_looked_up_without_garbage_collections():
    import gc

    words = token_output._Words(token_output.WordEncoder(queries.tokenizer_path("word_bpe_49k.json")), 2)
    runs = []
    gc.callbacks.append(lambda phase, info: runs.append(phase))
    try:
        got = words.numbers([f"{chr(97 + i % 26)}x{i}." for i in range(20_000)])
    finally:
        gc.callbacks.pop()
    assert not runs and gc.isenabled() and len(set(got.tolist())) == 20_000


def test_wavelet_matrix(monkeypatch):
    rng = np.random.default_rng(2)
    for chunk, size in ((32, 3000), (32, 512), (8192, 3000), (32, 1), (8192, 0)):
        monkeypatch.setattr(token_output, "CHUNK", chunk)
        x = rng.integers(0, 70, size).astype(np.uint16)
        ids, lengths, m = token_output.open_shard(token_output.pack_shard([1, None], [size // 3, size - size // 3], x))
        assert ids == [1, None] and lengths.sum() == size and (m.decode() == x).all()
        for i in {0, 1, 255, 256, 511, 512, size - 1} & set(range(size)):
            assert m.access(i) == x[i]
        for v in (0, 5, 69, 90, 200):
            where = np.flatnonzero(x == v)
            assert m.rank(v, size // 2) == (x[: size // 2] == v).sum() and m.select(v, len(where)) == -1
            assert [m.select(v, k) for k in range(len(where))] == where.tolist()


def test_a_token_is_read_from_few_chunks():
    x = np.random.default_rng(3).integers(0, 50_000, 400_000)
    _, _, m = token_output.open_shard(token_output.pack_shard([1], [len(x)], x))
    asked, fetch = set(), m.fetch
    m.fetch = lambda level, k: (asked.add((level, k)), fetch(level, k))[1]
    assert m.access(123_456) == x[123_456] and len(asked) <= 2 * m.levels < m.levels * (m.ranks.shape[1] - 1)


def test_mixing(docs, rows, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, mixing.target_sizes([size[s] for s in names]), strict=True))
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 * sum(size.values())
    taken = Counter()
    of = {i: s for i, _, s in rows}
    for r in got:
        taken[of[r["doc_id"]]] += r["taken"]
        assert abs(r["target"] - target[of[r["doc_id"]]]) < 1e-6 * r["target"] + 1e-9
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    mix = mixing.mixed_documents(docs)
    assert mix.columns == docs.columns
    n = sum(len(words(r["text"])) for r in mix.select("text").collect())
    assert n == sum(r["taken"] for r in got)
    assert mixing.mix_sources(empty).count() == mixing.mixed_documents(empty).count() == 0


def test_mix_keeps_sources_and_copies_apart(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text, "a"), (1, text, "b"), (2, text + " x", "b"), (2, text + " x", "b"), (3, None, "b"), (3, "", None), (3, "", None), (None, text + " y", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("SID", F.lit("mine")).withColumn("n_chars", F.lit(1).cast("long"))
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    mixed, taken = Counter(), Counter()
    for r in mixing.mixed_documents(df).collect():
        assert r["SID"] == "mine" and r["n_chars"] == len(r["text"])
        mixed[r["source"]] += len(r["text"].split())
    n = Counter()
    for _, t, s in rows:
        n[s] += len(words(t))
    names = sorted(n, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, mixing.target_sizes([n[s] for s in names]), strict=True))
    of = {round(target[s], 6): s for s in names if n[s]}
    for r in got:
        if r["size"]:
            taken[of[round(r["target"], 6)]] += r["taken"]
    assert mixed == taken and set(mixed) == {"a", "b", "c"}
    blocks = mixing.mixed_blocks(df).collect()
    assert sum(r["words"] for r in blocks) == sum(r["taken"] for r in got)


def test_plan_of_sources(spark):
    rng = random.Random(2)
    for sizes in ([100, 0, 10], [1, 1, 1000], [0, 0], [7], [rng.randint(0, 10**6) for _ in range(40)], [10**12, 3, 50, 10**9]):
        df = spark.createDataFrame([(f"s{i:03}", 1, n) for i, n in enumerate(sizes)], "source string, rows long, n long")
        got = [r["target"] for r in mixing.source_plan(df).orderBy("sid").collect()]
        assert np.allclose(got, mixing.target_sizes(sizes), rtol=1e-9) and abs(sum(got) - sum(sizes)) <= 1e-9 * sum(sizes)


def test_shares_by_range():
    whole = list(mixing.shares(10**6, 37, (5, 1)))
    assert sum(c for _, _, c in whole) == 10**6 and [f for _, f, _ in whole] == np.cumsum([0, *(c for _, _, c in whole)])[:-1].tolist()
    assert whole == [x for low in range(0, 37, 10) for x in mixing.shares(10**6, 37, (5, 1), low, min(37, low + 10))]
    assert abs(np.mean([c for _, _, c in whole]) - 10**6 / 37) < 1 and np.std([c for _, _, c in whole]) < 4 * math.sqrt(10**6 / 37)
    assert sum(c for _, _, c in mixing.shares(10**14, 3, (5, 2))) == 10**14


def test_targets_and_permutations():
    assert mixing.target_sizes([100, 0, 10]) == [100.0, 0.0, 10.0] or abs(sum(mixing.target_sizes([100, 0, 10])) - 110) < 1e-9
    assert mixing.target_sizes([1, 1, 1000])[:2] == [3.0, 3.0]
    for n in (1, 2, 7, 100, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 3).tolist()) == list(range(n))


def test_personal_data(spark, docs, empty):
    text = "mail a.b@c.de ip 1.2.3.4 and 1.2.3.999, card 4111 1111 1111 1111 call +1 (917) 555-2670 or (917) 555-2670. code 12"
    spans = pii.base_spans(text)
    assert [pii.KINDS[k] for k, _, _ in spans] == ["email", "ip", "card", "phone"]
    more = spark.createDataFrame([(i, text.replace("2670", f"{2000 + i}"), "en", "s", 1) for i in range(30)] + [(99, None, None, None, None)], SCHEMA)
    got = {r["doc_id"]: r for r in pii.personal_data(more).collect()}
    assert got[5]["n_phone"] == 1 and got[5]["base_sha256"] == hashlib.sha256(pii.written(pii.base_spans(text.replace("2670", "2005"))).encode()).hexdigest()
    at = text.index("or (917)") + 3
    assert got[5]["added"] == f"phone:{at}:{at + 14}" and got[99]["spans"] == ""
    here = pii.base_spans(text.replace("2670", "2005"))
    assert got[5]["spans"] == pii.written([*here, (3, at, at + 14)]) and set(pii.written(here).split(",")) < set(got[5]["spans"].split(","))
    clean = pii.personal_data(docs.where(~F.col("text").rlike("[0-9@]")))
    assert clean.where("spans <> ''").count() == 0
    for t in (r["text"] for r in docs.where("text is not null").limit(150).collect()):
        naive = [(0, *m.span()) for m in pii.PATTERNS["email"].finditer(t)]
        naive += [(3, *m.span()) for m in pii.PATTERNS["phone"].finditer(t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        assert [s for s in pii.base_spans(t) if s[0] in (0, 3)] == naive
    assert pii.personal_data(empty).count() == 0


def test_language_model(docs, rows, empty):
    file = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    teach = F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True))
    got = lm_scoring.score_documents(docs, file, teach).collect()
    count, n = Counter(), 0
    for i, t, _ in rows:
        if i is None or i % 7 != 2:
            count.update(words(t))
            n += 1
    total, distinct = sum(count.values()) + n, len(count) + 1
    want = Counter()
    for i, t, _ in rows:
        w = words(t)
        base = sum(np.log10((count[x] + 1) / (total + distinct + 1)) for x in w) + np.log10((n + 1) / (total + distinct + 1))
        want[i, len(w) + 1, sum(count[x] > 0 for x in w) + 1, total, round(base, 4)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm_scoring.score_documents(empty, file).count() == 0


def test_base_does_not_depend_on_the_broadcast_head(docs, monkeypatch):
    file = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    teach = F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True))
    fitted = lm_scoring.fit(docs.where(teach).select(F.coalesce("text", F.lit("")).alias("text")), file)

    def scored():
        got = lm_scoring.score_documents(docs, file, teach, fitted).collect()
        return sorted((r["doc_id"] or 0, r["n_known"], r["n_subwords"], r["base_score"], r["score"]) for r in got)

    whole = scored()
    for n_words in (300, 0):
        monkeypatch.setattr(lm_scoring, "HEAD_WORDS", n_words)
        assert np.allclose(scored(), whole, rtol=1e-9, atol=1e-6)


def test_head_is_bounded_however_high_counts_are(spark):
    counts = spark.createDataFrame([(str(i), 10**9 + i) for i in range(20)] + [("a", 3), ("b", 1)], "word string, n long")
    for most in (0, 5, 19, 20, 21, 22):
        assert counts.where(counts.n >= lm_scoring.least_count(counts, most)).count() <= most
    assert counts.where(counts.n >= lm_scoring.least_count(counts, 22)).count() == 22


def test_score_by_plain_loops(spark, docs):
    file = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    fitted = lm_scoring.fit(docs.select(F.coalesce("text", F.lit("")).alias("text")), file)
    texts = ["", "Hello World", " ".join(f"word{i} und Maß" for i in range(40)), "one\ttwo  THREE\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(df, file, fitted=fitted).collect()}
    p = {k: v.astype(float) for k, v in fitted.scorer.params.items()}
    vocab, encode = fitted.scorer.vocab, lm_scoring.load_ranks(file).encode_ordinary
    for n, t in enumerate(texts):
        ids = [i for w in words(t) for i in encode(" " + w.decode())] + [lm_scoring.END]
        before, total, start, done = [lm_scoring.BOS, *ids[:-1]], 0.0, 0, 0
        while done < len(ids):
            stop = min(len(ids), start + lm_scoring.WINDOW)
            h = np.array([p["E"][vocab.symbol[before[i]]] + p["P"][i - start] for i in range(start, stop)])
            for i in range(done, stop):
                k = i - start
                weight = np.array([np.exp(h[k] @ p["Q"] @ (h[j] @ p["K"]) / math.sqrt(lm_scoring.WIDTH)) for j in range(k + 1)])
                mixed = sum(w * (h[j] @ p["V"]) for j, w in enumerate(weight)) / weight.sum()
                h1 = h[k] + mixed @ p["O"]
                h2 = h1 + np.maximum(h1 @ p["W1"] + p["b1"], 0) @ p["W2"]
                logits = h2 @ p["C"] + p["c"]
                c = vocab.cls[ids[i]]
                total += (logits[c] - np.log(np.exp(logits).sum())) / math.log(10) + vocab.within[ids[i]]
            done, start = stop, start + lm_scoring.STRIDE
        assert got[n]["n_subwords"] == len(ids) and abs(got[n]["score"] - total) < 1e-3 * max(1, abs(total))
    share = np.zeros(lm_scoring.CLASSES)
    np.add.at(share, vocab.cls, 10.0 ** vocab.within)
    assert np.allclose(share[np.unique(vocab.cls)], 1)  # so that the scores of all next ids sum to one
    prior = lm_scoring.Scorer(vocab, {k: 0 * v if k != "c" else vocab.prior.astype(np.float32) for k, v in fitted.scorer.params.items()})
    ids = np.array([i for r in docs.limit(80).collect() if r["text"] for w in words(r["text"]) for i in encode(" " + w.decode())] + [lm_scoring.END])
    assert fitted.scorer.score(ids, np.array([len(ids)]))[0] > prior.score(ids, np.array([len(ids)]))[0]  # context helps


def test_every_document_gives_a_window():
    counts = np.array([0, 1, 255, 256, 1000, 5000])
    doc, first, own = lm_scoring.drawn_places(counts, np.random.default_rng(1).integers(-(2**63), 2**63, 6))
    assert len(set(own)) == len(doc)
    assert set(doc) == set(range(6)) and (first <= counts[doc]).all() and (np.bincount(doc) == counts // lm_scoring.DRAW_WORDS + 1).all()


def test_windows_score_each_token_once():
    read, scored, doc = lm_scoring.windows(np.array([1, 32, 33, 200]))
    on = scored[scored >= 0]
    assert sorted(on.tolist()) == list(range(266)) and (np.diff(doc) >= 0).all()
    ok = (scored >= 0) & (read >= 0)
    assert (read[ok] == scored[ok] - 1).all()


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lm_scoring.new_params(np.zeros(lm_scoring.CLASSES)).items()}
    x = rng.integers(0, lm_scoring.N_SYMBOLS, (2, lm_scoring.WINDOW))
    y = rng.integers(0, lm_scoring.CLASSES, (2, lm_scoring.WINDOW))
    g, _ = lm_scoring.gradients(p, x, y)
    for k in ("Q", "O", "W1", "C", "P", "E"):
        at = tuple(s // 2 for s in p[k].shape)
        old, e = p[k][at], 1e-3
        p[k][at] = old + e
        hi = lm_scoring.gradients(p, x, y)[1]
        p[k][at] = old - e
        lo = lm_scoring.gradients(p, x, y)[1]
        p[k][at] = old
        assert abs((hi - lo) / (2 * e) - g[k][at]) < 2e-3 * max(0.05, abs(g[k][at]))
    h, _ = lm_scoring.forward(p, x)
    z = x.copy()
    z[:, 20:] = 0
    h2, _ = lm_scoring.forward(p, z)
    assert np.allclose(h.reshape(2, 32, -1)[:, :20], h2.reshape(2, 32, -1)[:, :20])


def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    rows = out.orderBy("start").collect()
    assert rows and rows[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))


def test_pipeline_stages_by_hand(spark, docs, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    bench = [decontamination.terms(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        df = spark.read.parquet(f"{tmp_path}/{n}")
        kept.append([r.asDict() for r in df.collect()])
        assert n == 4 or df.columns == docs.columns
    every = [r.asDict() for r in docs.collect()]
    judged = language_id.identify(docs, language_id.fit(docs)).select("text", "language.*").collect()
    good = Counter(r["text"] for r in judged if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SHARE)
    assert Counter(r["text"] for r in kept[0]) == good and sum(good.values()) < len(every)

    def shingles(t):
        w = words(t)
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = [shingles(r["text"]) for r in kept[0]]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = Counter(find(sets.index(shingles(r["text"]))) for r in kept[1])
    assert set(groups) == {find(i) for i in range(len(sets))} and set(groups.values()) == {1}

    def holds(t):
        w = decontamination.terms(t)
        have = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return any(len(s & have) >= 0.8 * len(s) for s in ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in bench))

    assert Counter(r["text"] for r in kept[2]) == Counter(r["text"] for r in kept[1] if not holds(r["text"]))
    size = Counter()
    for r in kept[2]:
        size[r["source"]] += len(words(r["text"]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    mixed = Counter()
    for r in kept[3]:
        mixed[r["source"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert all(abs(mixed[s] - t) <= 2 * mixing.BLOCK_WORDS for s, t in zip(names, mixing.target_sizes([size[s] for s in names]), strict=True))
    whole = {(r["doc_id"], r["source"]): Counter(words(r["text"])) for r in kept[2]}
    assert all(not Counter(words(r["text"])) - whole[r["doc_id"], r["source"]] for r in kept[3])
    tok, at = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json")), 0
    in_order = sorted(kept[3], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"]))
    for r, g in zip(in_order, sorted(kept[4], key=lambda r: r["start"]), strict=True):
        ids = [*tok.encode(r["text"], add_special_tokens=False).ids, 2]
        assert g == {"doc_id": r["doc_id"], "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        at += len(ids)


def test_pipeline_on_empty_tables(spark, empty, tmp_path):
    import corpus_pipeline

    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_base_spans_as_plain_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice("a1.@- _+2") for _ in range(rng.randint(0, 30)))
        naive = [(0, *m.span()) for m in pii.PATTERNS["email"].finditer(t)]
        naive += [(1, *m.span()) for m in pii.PATTERNS["ip"].finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
        assert [s for s in pii.base_spans(t) if s[0] in (0, 1)] == naive
    long = "a" * 200_000 + " x@y.z " + "1" * 200_000
    assert pii.base_spans(long) == [(0, 200_001, 200_006)]
    zeros = "0" * 5000 + "1.2.3.4 " + "0" * 5000 + ".1.2." + "0" * 6000 + " " + "9" * 5000 + ".1.2.3"
    assert [s for s in pii.base_spans(zeros) if s[0] == 1] == [(1, 0, 5007), (1, 5008, 5008 + 5000 + 5 + 6000)]


def test_long_digit_runs_do_not_end_the_query(spark):
    texts = ["0" * 5000 + "1.2.3.4", "1" * 9000, "+" + "1" * 9000, "plain", None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_ip string")
    got = {r["doc_id"]: r["n_ip"] for r in pii.personal_data(df).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0}


def test_card_spans_as_plain_pattern():
    def checksum(d):
        twice = [sum(divmod(2 * int(x), 10)) for x in d[-2::-2]]
        return (sum(twice) + sum(int(x) for x in d[-1::-2])) % 10 == 0

    rng, hits = random.Random(8), 0
    for _ in range(4000):
        t = "".join(rng.choice("0123456789" * 4 + " -.x") for _ in range(rng.randint(14, 60)))
        want = []
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m.group())
            if 16 <= len(d) <= 19 and checksum(d):
                want.append((2, *m.span()))
        assert [s for s in pii.base_spans(t) if s[0] == 2] == want
        hits += len(want)
    assert hits > 50


def enumerated(field, masks, edges, clamp):
    """Exact beliefs by summing over all labellings."""
    from itertools import product

    x = np.array([[1, *((m >> i) & 1 for i in range(pii.N_FEATURES))] for m in masks], float)
    unary, out = x @ field.weights, np.zeros((len(masks), pii.N_LABELS))
    for y in product(range(pii.N_LABELS), repeat=len(masks)):
        if all(not c or c == v for c, v in zip(clamp, y, strict=True)):
            s = np.exp(sum(unary[n, v] for n, v in enumerate(y)) + sum(field.pairs[k, y[i], y[j]] for i, j, k in edges))
            for n, v in enumerate(y):
                out[n, v] += s
    return out / out.sum(1, keepdims=True)


def test_beliefs_on_trees_and_small_loops(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(pii, "ROUNDS", 40)
    for n in range(12):
        field = pii.Field(rng.normal(0, 1, (pii.N_FEATURES + 1, pii.N_LABELS)), rng.normal(0, 1, (3, pii.N_LABELS, pii.N_LABELS)))
        masks, clamp = rng.integers(0, 1 << pii.N_FEATURES, 5).tolist(), [0, 3 * (n % 2), 0, 0, 0]
        tree = [(0, 1, 0), (1, 2, 0), (1, 3, 1), (0, 4, 2)]
        assert np.allclose(pii.beliefs(field, masks, tree, clamp), enumerated(field, masks, tree, clamp), atol=1e-6)
        mild = pii.Field(field.weights, 0.3 * field.pairs)
        loop = [*tree, (3, 4, 1), (2, 3, 0)]
        assert np.allclose(pii.beliefs(mild, masks, loop, clamp), enumerated(mild, masks, loop, clamp), atol=0.05)


def test_slopes_by_differences():
    rng = np.random.default_rng(6)
    cases = [c for _ in range(6) for c in pii._cases(rng.integers(0, 1 << pii.N_FEATURES, 4).tolist(), rng.integers(0, 5, 4).tolist(), [(0, 1, 0), (1, 3, 1), (0, 2, 2)])]
    masks, y, near = np.array([c[0] for c in cases]), np.array([c[1] for c in cases]), [c[2] for c in cases]
    n, theta = rng.integers(1, 50, len(cases)), rng.normal(0, 0.5, pii.N_PARAMS)

    def loss(t):
        field, total = pii.field_of(t), 0.0
        for m, label, w, k in zip(masks, y, near, n, strict=True):
            into, out = np.frombuffer(w, np.uint8).reshape(2, 3, pii.N_LABELS)
            pair = np.einsum("ka,kac->c", into, field.pairs) + np.einsum("ka,kca->c", out, field.pairs)
            for own in ([1, *((m >> i) & 1 for i in range(pii.N_FEATURES))], [1] + [0] * pii.N_FEATURES):
                s = np.array(own) @ field.weights + pair
                total += np.log1p(k) * (np.log(np.exp(s).sum()) - s[label])
        return total

    slopes, step = pii._slopes(theta, masks, y, near, n), 1e-5
    for i in range(0, pii.N_PARAMS, 7):
        e = step * np.eye(pii.N_PARAMS)[i]
        assert abs((loss(theta + e) - loss(theta - e)) / (2 * step) - slopes[i]) < 1e-3
        second = (pii._slopes(theta + e, masks, y, near, n)[: pii.N_PARAMS] - pii._slopes(theta - e, masks, y, near, n)[: pii.N_PARAMS]) / (2 * step)
        assert np.allclose(second, slopes[pii.N_PARAMS :].reshape(pii.N_PARAMS, -1)[i], atol=1e-3)


def test_fit_without_and_with_cases(spark):
    none = pii.fit(spark.createDataFrame([], "text string"))
    assert np.array_equal(none.weights, pii.field_of(pii.prior()).weights) and np.allclose(none.pairs, pii.field_of(pii.prior()).pairs)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """Training windows follow from rows: dealing the table anew changes scores by rounding alone."""
    monkeypatch.setattr(lm_scoring, "SHARD_WINDOWS", 100)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    file = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    got = [{r["doc_id"]: r["score"] for r in lm_scoring.score_documents(docs.repartition(n), file).collect()} for n in (1, 7)]
    assert got[0].keys() == got[1].keys() and all(abs(got[0][k] - v) <= 1e-6 * abs(v) for k, v in got[1].items())


def test_a_language_of_copies_is_not_lost(spark):
    """Copies of one German text are drawn each for itself; so is a single repeated row."""
    english = [(i, f"the house number {i} of this street and that", "en") for i in range(50)]
    for ids in (lambda i: 1000 + i, lambda i: 1000):
        rows = english + [(ids(i), "hallo welt das ist ein text", "de") for i in range(3000)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = language_id.fit(df, 10)
        ask = spark.createDataFrame([(1, "hallo welt"), (2, "the street")], "doc_id long, text string")
        assert [r["p"] for r in language_id.identify(ask, model).orderBy("doc_id").select(F.col("language.lang_pred").alias("p")).collect()] == ["de", "en"]


def test_mixed_rows_that_differ_in_nested_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", "s", [1, 2], {"k": 1}), (1, "a b c d", "s", [3], {"k": 1}), (1, "a b c d", "s", [3], {"k": 2})], "doc_id long, text string, source string, n array<int>, m map<string,int>")
    got = mixing.mixed_documents(df, block_words=2).collect()
    assert Counter((tuple(r["n"]), r["m"]["k"]) for r in got) == Counter({((1, 2), 1): 1, ((3,), 1): 1, ((3,), 2): 1})


def test_taken_counts_the_written_shards(spark, tmp_path):
    """Every document's share of the mix, from the blocks in the written files one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed, taken = mixing._plan(docs, "doc_id", "text", "source", F.xxhash64("doc_id", "text"), 17, mixing.BLOCK_WORDS)
    mix = mixing.read_mix(spark, mixing.write_mix(taken, str(tmp_path / "mix"))).collect()
    slots = [(r["sid"], r["slot"]) for r in mix]
    assert len(set(slots)) == len(slots)
    times = Counter((r["sid"], r["block"]) for r in mix)
    want = Counter()
    for r in placed.collect():
        words = Counter((r["start"] + i) // mixing.BLOCK_WORDS for i in range(r["size"]))
        want[r["doc_id"], sum(times[r["sid"], b] * n for b, n in words.items())] += 1
    assert Counter((r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs).collect()) == want


def test_a_frequent_line_sends_two_hashes_a_batch(spark):
    df = spark.createDataFrame([(i, f"same\nown {i}\npair {i // 2}") for i in range(500)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_dropped"], r["kept_text"]) for r in line_dedup.repeated_lines(df, min_docs=2).collect()}
    assert got == {i: (2, f"own {i}") for i in range(500)}


def test_field_finds_hidden_labels(spark):
    """One base span in five gives up its label: the field finds most of them, and the belief it asks for keeps its precision."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = pii.fit(docs)
    hidden = pii.hidden_labels(docs, field).toPandas()
    assert field.recall > 0.3 and field.precision >= pii.PRECISION and field.belief >= pii.BELIEF
    at = hidden[hidden["belief"] >= round(100 * field.belief)]
    assert at["found"].sum() >= pii.PRECISION * (at["found"] + at["wrong"]).sum()
    assert hidden["found"].sum() + hidden["missed"].sum() > 10
    pd = pytest.importorskip("pandas")
    assert pii.choose_belief(pd.DataFrame({"belief": [70, 90, 0], "found": [1, 9, 0], "wrong": [5, 0, 0], "missed": [0, 0, 10]})) == (0.9, 0.45, 1.0)
    assert pii.choose_belief(pd.DataFrame({"belief": [70], "found": [1], "wrong": [5], "missed": [0]}))[0] > 1
    assert pii.choose_belief(pd.DataFrame({"belief": [], "found": [], "wrong": [], "missed": []}))[0] > 1
