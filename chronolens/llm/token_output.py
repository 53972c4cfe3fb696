"""Token-id output: one wavelet matrix for each shard of documents.

A shard holds the token ids of consecutive documents in ascending doc_id order. Ids are stored
bit by bit, highest first; after each plane the ids are stably parted into zeros and ones.
Planes are compressed in chunks, and the file keeps where each chunk lies and how many ones
stand before it, so that a token is read, counted and found from a few chunks of the compressed
file. Shards are binary cells that Spark writes, one row for each.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, shared_dir, text_of, tidy

#: Documents are collected to a shard until it has so many ids.
SHARD_IDS = 4_000_000
#: UTF-8 bytes of text dealt to one task.
TASK_BYTES = 24_000_000
MAGIC, VERSION, HEADER = b"WVMX", 2, struct.Struct("<4sBBHQQQ")
#: Bytes of a plane that are compressed together; the rank directory has an entry for each.
CHUNK = 8192
#: Ids of a plane that are parted together; rows that are encoded together. Both bound a worker's memory.
BLOCK, TOGETHER = 1 << 18, 250
#: Words that a task remembers before it starts anew; pieces of words that it remembers, half of them those met last.
CACHE_WORDS, CACHE_PIECES = 300_000, 300_000


class WaveletMatrix:
    """Succinct sequence of unsigned integers: access, rank (count) and select (lookup) from bit planes."""

    def __init__(self, n: int, ranks: np.ndarray, fetch: Callable[[int, int], np.ndarray]):
        """ranks: [levels, chunks + 1], the ones of a plane before each chunk; fetch: (level, chunk) -> its bytes, bits in little order."""
        self.n, self.ranks, self.fetch, self.levels = n, ranks, fetch, len(ranks)
        self.zeros = [n - int(r[-1]) for r in ranks]

    @staticmethod
    def planes_of(ids: np.ndarray, levels: int) -> list[np.ndarray]:
        """The packed bits of each plane, highest first."""
        planes, seq = [], ids
        for b in range(levels - 1, -1, -1):
            bit = (seq & (1 << b)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            if b:
                parted, zero = np.empty_like(seq), 0
                one = len(seq) - int(np.count_nonzero(bit))
                for k in range(0, len(seq), BLOCK):
                    own, of = seq[k : k + BLOCK], bit[k : k + BLOCK]
                    zeros, ones = np.flatnonzero(~of), np.flatnonzero(of)
                    parted[zero : zero + len(zeros)] = own.take(zeros)
                    parted[one : one + len(ones)] = own.take(ones)
                    zero, one = zero + len(zeros), one + len(ones)
                seq = parted
        return planes

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        k, at = divmod(i, 8 * CHUNK)
        if not at:
            return int(self.ranks[level][k])
        part = self.fetch(level, k)[: (at + 7) // 8]
        over = int(part[-1]) >> (at % 8) if at % 8 else 0
        return int(self.ranks[level][k]) + int(np.bitwise_count(part).sum()) - over.bit_count()

    def _bit(self, level: int, i: int) -> int:
        k, at = divmod(i, 8 * CHUNK)
        return int(self.fetch(level, k)[at >> 3] >> (at & 7)) & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` before position i lie below the last plane."""
        lo, hi = 0, min(max(i, 0), self.n)
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            one = value >> (self.levels - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if one else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """How often ``value`` stands before position i."""
        lo, hi = self._range(value, i)
        return hi - lo if value >= 0 and value >> self.levels == 0 else 0

    def select(self, value: int, k: int) -> int:
        """Position of occurrence k (from 0) of ``value``; -1 if there are fewer."""
        if k < 0 or self.rank(value, self.n) <= k:
            return -1
        at = self._range(value, self.n)[0] + k
        for level in range(self.levels - 1, -1, -1):
            one = value >> (self.levels - 1 - level) & 1
            want, before = at - self.zeros[level] if one else at, self.ranks[level].astype(np.int64)
            if not one:
                before = np.minimum(np.arange(len(before)) * 8 * CHUNK, self.n) - before
            c = int(np.searchsorted(before, want, "right")) - 1  # the chunk that holds this zero or one
            bits = np.unpackbits(self.fetch(level, c), bitorder="little")
            at = c * 8 * CHUNK + int(np.flatnonzero(bits == one)[want - int(before[c])])
        return at

    def decode(self) -> np.ndarray:
        """All ids: planes from the lowest up, each partition undone."""
        out = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            plane = np.concatenate([self.fetch(level, k) for k in range(self.ranks.shape[1] - 1)] or [np.zeros(0, np.uint8)])
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            up = np.empty_like(out)
            up[np.flatnonzero(~bit)] = out[: self.zeros[level]]
            up[np.flatnonzero(bit)] = out[self.zeros[level] :] | out.dtype.type(1 << (self.levels - 1 - level))
            out = up
        return out.astype(np.uint32)


def pack_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The file format: header, document table, ends of the chunks, rank directory, chunks; little-endian."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    planes = WaveletMatrix.planes_of(ids.astype(np.uint16 if levels <= 16 else np.uint32), levels)
    ranks = np.zeros((levels, -(-len(planes[0]) // CHUNK) + 1), np.uint64)
    chunks = []
    for level, p in enumerate(planes):
        ones = np.add.reduceat(np.bitwise_count(p), np.arange(0, len(p), CHUNK), dtype=np.uint64) if len(p) else np.zeros(0, np.uint64)
        ranks[level, 1:] = np.cumsum(ones)
        chunks += [squeeze(p[i : i + CHUNK].tobytes()) for i in range(0, len(p), CHUNK)]
    table = np.array([x if x is not None else 0 for x in doc_ids], np.int64).tobytes()
    null = np.packbits(np.array([x is None for x in doc_ids], bool)).tobytes()
    docs = squeeze(table + null + np.asarray(lengths, np.uint64).tobytes())
    ends = np.cumsum([len(c) for c in chunks], dtype=np.uint64).tobytes()
    return b"".join([HEADER.pack(MAGIC, VERSION, levels, 0, len(doc_ids), len(ids), len(docs)), docs, ends, ranks.tobytes(), *chunks])


def open_shard(blob: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """(doc ids, lengths, matrix) of a shard; a chunk of a plane is unpacked when it is first asked for."""
    import zstandard

    magic, version, levels, _, n_docs, n, n_table = HEADER.unpack_from(blob)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a shard of this format")
    unpack = zstandard.ZstdDecompressor().decompress
    body, at = unpack(blob[HEADER.size : HEADER.size + n_table]), HEADER.size + n_table
    each = -(-(-(-n // 8)) // CHUNK)
    ends = np.frombuffer(blob, np.uint64, levels * each, at)
    ranks = np.frombuffer(blob, np.uint64, levels * (each + 1), at + ends.nbytes).reshape(levels, each + 1)
    first = at + ends.nbytes + ranks.nbytes
    have: dict[int, np.ndarray] = {}

    def fetch(level: int, k: int) -> np.ndarray:
        i = level * each + k
        if i not in have:
            a = int(ends[i - 1]) if i else 0
            have[i] = np.frombuffer(unpack(blob[first + a : first + int(ends[i])]), np.uint8)
        return have[i]

    ids, null = np.frombuffer(body, np.int64, n_docs), np.frombuffer(body, np.uint8, -(-n_docs // 8), 8 * n_docs)
    lengths = np.frombuffer(body, np.uint64, n_docs, 8 * n_docs + null.nbytes).astype(np.int64)
    none = np.unpackbits(null, count=n_docs).astype(bool)
    return [None if x else int(i) for i, x in zip(ids, none, strict=True)], lengths, WaveletMatrix(n, ranks, fetch)


#: What a tokenizer file has to say for its texts to be cut here; any other file's texts are encoded whole by the library. Fixed values.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _CUT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
#: Printable ASCII and the Latin letters of one code point up to 255: what is cut here rather than by the tokenizer.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_SIGNS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, str]:
    """Letters beyond ASCII as byte-level models spell them: printable bytes stand for themselves, the others count on from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spelt = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
    return {c: "".join(spelt[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_SPELT = _byte_letters()


def cut_as_known(spec: dict) -> bool:
    """Does a tokenizer file cut texts by the rules that are built in here?"""
    model = spec["model"]
    return (
        all(spec.get(k) == v for k, v in _RULES.items())
        and model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and all("<|" in t["content"] and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    )


class WordEncoder:
    """Words -> ids with the tokenizers library; texts as a whole if the file's rules aren't the built-in ones.

    Words are what ASCII white space parts; a tokenizer of the built-in rules never joins across
    it, so a text's ids are its words' ids in order. Plain words are first cut as it cuts them.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            self.by_word = cut_as_known(json.load(f))
        self.tokenize = self.tok.model.tokenize  # asking for the model makes an object each time
        self.pieces: dict[str, bytes] = {}  # ids in 4 bytes each
        self.before: dict[str, bytes] = {}  # pieces met before the last half; those that are met again come back

    def _piece(self, p: str) -> bytes:
        got = self.pieces.get(p)
        if got is None:
            if len(self.pieces) >= CACHE_PIECES // 2:
                self.before, self.pieces = self.pieces, {}
            got = self.before.get(p)
            if got is None:
                got = array("I", [t.id for t in self.tokenize(p if p.isascii() else p.translate(_SPELT))]).tobytes()
            self.pieces[p] = got
        return got

    def word(self, w: str) -> bytes:
        """The ids of a word, in 4 bytes each."""
        if w.isascii() or _PLAIN.fullmatch(w):
            if "<|" not in w:
                low = w.lower()
                w = w if low == w else low  # one string for the word and its piece
                if w.isalpha():
                    return self._piece(w)
                head = w[:-1]
                if head.isalpha() and w[-1] in _SIGNS:
                    return self._piece(head) + self._piece(w[-1])
                if w.isprintable():
                    return b"".join(map(self._piece, _PIECES.findall(w)))
        return array("I", self.tok.encode(w, add_special_tokens=False).ids).tobytes()


class _Words(dict):
    """Word -> its number; 0 is the empty word, which has no ids, 1 closes a document. Grows by what is looked up."""

    def __init__(self, encoder: WordEncoder, end: int):
        super().__init__({"": 0})
        self.encoder = encoder
        self.flat, self.first, self.sizes = array("I", [end]), array("q", [0, 0]), array("q", [0, 1])

    def __missing__(self, w: str) -> int:
        ids = self.encoder.word(w)
        self.first.append(len(self.flat))
        self.sizes.append(len(ids) // 4)
        self.flat.frombytes(ids)
        self[w] = n = len(self.sizes) - 1
        return n

    def numbers(self, names: list[str]) -> np.ndarray:
        """Numbers of words. New ones make no cycles, so the garbage collector, which would walk through all that is kept again and again, waits."""
        was = gc.isenabled()
        gc.disable()
        try:
            return np.fromiter(map(self.__getitem__, names), np.int64, len(names))
        finally:
            if was:
                gc.enable()


def encode_texts(words: _Words, texts) -> tuple[np.ndarray, np.ndarray]:
    """(ids of an Arrow array of texts, each closed by the end id; number of ids of each)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if words.encoder.by_word:
        marked = pc.match_substring(texts, "<|")  # the tokenizer's own tokens are not lower-cased
        parts = pc.ascii_split_whitespace(pc.if_else(marked, texts, pc.ascii_lower(texts)))
        coded, counts = parts.flatten().dictionary_encode(), np.diff(parts.offsets.to_numpy())
        names, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        index = words.numbers(names)[index]
        w = np.insert(index, np.cumsum(counts), 1)
        flat, first, sizes = (np.frombuffer(x, k) for x, k in ((words.flat, np.uint32), (words.first, np.int64), (words.sizes, np.int64)))
        n = sizes[w]
        ids = flat[np.arange(n.sum()) + np.repeat(first[w] - (np.cumsum(n) - n), n)]
        return ids, np.add.reduceat(n, np.cumsum([0, *(counts[:-1] + 1)])) if len(counts) else np.zeros(0, np.int64)
    got = [e.ids for e in words.encoder.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
    closed = [x for ids in got for x in (*ids, words.flat[0])]
    return np.array(closed, np.uint32), np.array([len(ids) + 1 for ids in got], np.int64)


def write_tokens(docs: DataFrame, tokenizer_file: str, end_id: int = 2, path: str | None = None,
                 doc_id: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> str:
    """Write the ids of ``docs`` in ascending doc_id order (null ids first, repeated ids by text) and return the folder.

    A row: shard (ascending with doc_id), n_ids, payload. Null text counts as empty; each
    document is closed by ``end_id``. ``tokenizer_file`` has to be readable by every worker.
    ``doc_id`` is a long; extra columns are left out; an empty table gives no shard.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // TASK_BYTES))
    bounded_batches(spark)

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        words = _Words(WordEncoder(tokenizer_file), end_id)  # of this task alone
        part, seq = TaskContext.get().partitionId(), 0
        ids, lengths, held, have = [], [], [], 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, have
            payload = pack_shard(held, np.concatenate(lengths), np.concatenate(ids))
            out = pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + seq], pa.int64()), pa.array([have], pa.int64()), pa.array([payload], pa.binary())],
                ["shard", "n_ids", "payload"],
            )
            seq, have = seq + 1, 0
            ids.clear(), lengths.clear(), held.clear()
            give_back()
            return out

        for batch in batches:
            if len(words) > CACHE_WORDS:
                words = _Words(words.encoder, end_id)
            for k in range(0, len(batch), TOGETHER):
                got, n_ids = encode_texts(words, batch.column(1).slice(k, TOGETHER))
                ids.append(got), lengths.append(n_ids)
                have += len(got)
            held.extend(batch.column(0).to_pylist())
            if have >= shard_ids:
                yield shard()
        if held:
            yield shard()

    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(tidy(encode), "shard long, n_ids long, payload binary").write.option("compression", "none").parquet(path)
    return path


def _offsets(shards: DataFrame) -> DataFrame:
    """(shard, base): the ids before each shard. Sums of 1024 tasks each come first, so that no task sees all shards."""
    sizes = shards.select("shard", "n_ids", F.shiftright("shard", 34).alias("group"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("group").agg(F.sum("n_ids").alias("n"))
    groups = groups.select("group", F.sum("n").over(before(Window.orderBy("group"))).alias("before"))
    within = F.sum("n_ids").over(before(Window.partitionBy("group").orderBy("shard")))
    own = sizes.select("shard", "group", within.alias("within")).join(groups, "group")
    return own.select("shard", (F.coalesce("before", F.lit(0)) + F.coalesce("within", F.lit(0))).alias("base"))


def read_tokens(spark, path: str) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = spark.read.schema("shard long, n_ids long, payload binary").parquet(path)

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, lengths, matrix = open_shard(blob.as_py())
                raw = memoryview(matrix.decode().astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [np.full(len(doc_ids), shard), doc_ids, starts, lengths, crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("shard", "payload").mapInArrow(tidy(decode), "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(_offsets(shards), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(spark, path: str, tokens: list[int]) -> DataFrame:
    """How often each of ``tokens`` stands in the files, and where first (-1: nowhere): shard, token, n, first; by rank and select alone."""
    shards = spark.read.schema("shard long, n_ids long, payload binary").parquet(path)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, _, m = open_shard(blob.as_py())
                columns = [[shard] * len(tokens), tokens, [m.rank(t, m.n) for t in tokens], [m.select(t, 0) for t in tokens]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "token", "n", "first"])

    return shards.select("shard", "payload").mapInArrow(count, "shard long, token long, n long, first long")
