"""Python workers serve many stages: what a task remembers is compact, bounded, and gone when it is over."""

import tracemalloc

import pyarrow as pa

from chronolens.llm import alignment, common, queries, token_output


def test_a_remembered_word_takes_few_bytes():
    """A new word and its piece are one string, their ids 4 bytes each: 184 bytes together (333 with tuples of numbers)."""
    words = token_output._Words(token_output.WordEncoder(queries.tokenizer_path("word_bpe_49k.json")), 2)
    letters = [chr(97 + i) for i in range(26)]
    names = ["q" + a + b + "xqz" + c + d for a in letters for b in letters for c in letters for d in letters[:2]]
    tracemalloc.start()
    try:
        words.numbers(names)
        took = tracemalloc.get_traced_memory()[0] / len(names)
    finally:
        tracemalloc.stop()
    assert took < 250


def test_frequent_pieces_stay_when_others_are_let_go(monkeypatch):
    monkeypatch.setattr(token_output, "CACHE_PIECES", 100)
    encoder = token_output.WordEncoder(queries.tokenizer_path("word_bpe_49k.json"))
    asked, tokenize = [], encoder.tokenize
    encoder.tokenize = lambda p: asked.append(p) or tokenize(p)
    first = encoder.word("often")
    for i in range(1000):
        encoder.word(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}z")
        assert encoder.word("often") == first and len(encoder.pieces) + len(encoder.before) <= 101
    assert asked.count("often") == 1


def test_a_task_leaves_no_words_behind(spark):
    """Workers serve the next stages too: what a task remembered of words is gone when it is over."""
    docs = spark.createDataFrame([(i, f"words of text {i} and others that stand here") for i in range(50)], "doc_id long, text string")
    token_output.write_tokens(docs.coalesce(1), queries.tokenizer_path("word_bpe_49k.json"))

    def left(batches):
        import gc

        yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ in ("WordEncoder", "_Words") for x in gc.get_objects())])], ["n"])

    assert not any(r["n"] for r in spark.range(64).repartition(16).mapInArrow(left, "n long").collect())


def test_tidy_gives_memory_back_after_the_last_batch(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("back"))
    got = []
    for x in common.tidy(lambda batches: (b + 1 for b in batches))(iter([1, 2])):
        got.append((x, len(seen)))
    assert got == [(2, 0), (3, 0)] and seen == ["back"]


def test_an_alignment_leaves_no_stretches_behind(spark):
    """Both passes of an alignment: a task's stretches are gone when it is over, also where they began anew meanwhile."""
    docs = spark.createDataFrame([(i, f"words of text {i} and others that stand here") for i in range(50)], "doc_id long, text string")
    files = [queries.tokenizer_path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    assert alignment.align_tokenizers(docs.coalesce(1), *files).where("n_links > 0").count() == 50

    def left(batches):
        import gc

        yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "Stretches" for x in gc.get_objects())])], ["n"])

    assert not any(r["n"] for r in spark.range(64).repartition(16).mapInArrow(left, "n long").collect())


def test_a_forgetful_task_gives_memory_back_when_it_is_over(monkeypatch):
    seen = []
    monkeypatch.setattr(alignment, "give_back", lambda: seen.append(dict(alignment._memos)))
    monkeypatch.setattr(alignment, "_memos", {"of a task that was ended early": None})

    def work(batches):
        assert not alignment._memos
        for b in batches:
            alignment._memo("job", dict)
            yield b

    assert list(alignment._forgetful(work)(iter([1, 2]))) == [1, 2] and seen == [{}, {}]
