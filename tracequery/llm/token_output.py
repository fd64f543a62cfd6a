"""Token-id output in directly addressable codes.

Ids are cut into chunk levels of fixed widths. Level 0 holds the low chunk of every id; a continuation
bitmap marks the ids that go on, whose next chunks stand densely in level 1, and so on. A rank
directory over each bitmap tells how many ids before a position go on, so any single token is read with
one chunk and one rank lookup per level, without decoding its block.

A file set is a Parquet table of shards (so any store Spark writes to can hold it); each shard carries
one binary code, the documents in it and where it starts. Shards stand in ascending ``doc_id`` order.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import scratch_path

MAGIC = b"DAC1"
WIDTHS = (8, 8, 16)
RANK_STEP = 256
END_ID = 2
SHARD_TOKENS = 1 << 18
CACHED_WORDS = 1_000_000
TEXTS_AT_ONCE = 256

SHARD_SCHEMA = "part int, shard int, before long, doc_ids array<long>, sizes array<long>, n_ids long, code binary"


def dac_encode(ids: np.ndarray) -> bytes:
    """The code of unsigned 32-bit ids: a header, then per level its chunks, bitmap and rank directory."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    parts = []
    for level, width in enumerate(WIDTHS):
        chunks = (rest & np.uint32((1 << width) - 1)).astype(np.uint8 if width <= 8 else "<u2")
        high = rest >> np.uint32(width)
        more = high > 0
        last = level + 1 == len(WIDTHS) or not more.any()
        bits = b"" if last else np.packbits(more, bitorder="little").tobytes()
        ranks = b"" if last else _rank_directory(more)
        parts.append((width, len(rest), last, chunks.tobytes(), bits, ranks))
        if last:
            break
        rest = high[more]
    head = MAGIC + struct.pack("<I", len(parts))
    head += b"".join(struct.pack("<BBQIII", w, last, n, len(c), len(b), len(r)) for w, n, last, c, b, r in parts)
    return head + b"".join(c + b + r for *_, c, b, r in parts)


def _rank_directory(more: np.ndarray) -> bytes:
    counts = np.add.reduceat(more, np.arange(0, len(more), RANK_STEP), dtype=np.int64)
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4").tobytes()


class DacReader:
    """Random access to a code; nothing is decoded on opening."""

    def __init__(self, code: bytes):
        if code[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        (n_levels,) = struct.unpack_from("<I", code, 4)
        at, heads = 8, []
        for _ in range(n_levels):
            heads.append(struct.unpack_from("<BBQIII", code, at))
            at += struct.calcsize("<BBQIII")
        self.levels = []
        for width, last, n, n_chunks, n_bits, n_ranks in heads:
            chunks = np.frombuffer(code, np.uint8 if width <= 8 else "<u2", n, at)
            at += n_chunks
            bits = np.frombuffer(code, np.uint8, n_bits, at)
            at += n_bits
            ranks = np.frombuffer(code, "<u4", n_ranks // 4, at)
            at += n_ranks
            self.levels.append((width, bool(last), chunks, bits, ranks))
        self.n_ids = self.levels[0][2].size if self.levels else 0

    def __len__(self) -> int:
        return self.n_ids

    def __getitem__(self, i: int) -> int:
        """The id at position i, by one rank lookup per level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for width, last, chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += width
            if last or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_STEP
            start = block * RANK_STEP // 8
            inside = int(np.bitwise_count(bits[start : i >> 3]).sum()) if i >> 3 > start else 0
            tail = int(bits[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(ranks[block]) + inside + tail.bit_count()
        return value

    def decode(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(self.n_ids, dtype=np.uint32)
        at, shift = None, 0
        for width, last, chunks, bits, _ in self.levels:
            part = chunks.astype(np.uint32) << np.uint32(shift)
            if at is None:
                out |= part
            else:
                out[at] |= part
            if last:
                break
            more = np.flatnonzero(np.unpackbits(bits, count=chunks.size, bitorder="little"))
            at = more if at is None else at[more]
            shift += width
        return out


#: White space on which the tokenizers library and str.split() might differ, beside the special tokens' strings.
_ODD_SPACE = "\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks between an ASCII letter and the end of its word; fixed to ASCII, where nothing combines.
_END_MARKS = r"([A-Za-z])([!-/:-@\[-^`{-~]+(?:\s|$))"
_LETTERS_THEN_MARKS = re.compile(r"[^\W\d_]+[^\w\s]+")


class WordEncoder:
    """Ids of whole texts through the tokenizers library, with a bounded cache of words.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its words in
    turn. Each new word goes through the library once per worker. Where the tokenizer lowers ASCII letters and
    cuts marks off them (tried out on all of these at the start), words are cached in lower case and without
    the marks at their ends. Words of letters only have at least one
    piece, letters followed by marks at least two; they are encoded many to a call and cut apart at the tokens
    that end a piece, unless the number of pieces shows that some word has more. Texts with unusual white space or the strings of special tokens are encoded
    whole.
    """

    def __init__(self, tokenizer_json: str):
        self.tok = Tokenizer.from_str(tokenizer_json)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        special = "|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values())
        self.odd = f"[{_ODD_SPACE}]" + (f"|{special}" if special else "")
        self.cache: dict[str, bytes] = {"": b""}
        marks = [chr(c) for c in range(33, 127) if chr(c) != "_" and not chr(c).isalnum()]
        self.lowers = all(self._same(x.upper(), x) for x in ("abcdefghijklmnopqrstuvwxyz", *"abcdefghijklmnopqrstuvwxyz"))
        self.cuts = all(self._same(f"ab{m}", f"ab {m}") for m in (*marks, "".join(marks)))

    def _same(self, a: str, b: str) -> bool:
        return self.tok.encode(a, add_special_tokens=False).ids == self.tok.encode(b, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        for pieces, plain in ((1, [w for w in words if w.isalpha()]), (2, [w for w in words if not w[-1].isalpha() and _LETTERS_THEN_MARKS.fullmatch(w)])):
            for i in range(0, len(plain), 500):
                some = plain[i : i + 500]
                ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) == pieces * len(some):
                    data, stops = ids.tobytes(), (stops[pieces - 1 :: pieces] * 4).tolist()
                    self.cache.update(zip(some, [data[a:b] for a, b in zip([0, *stops], stops)]))
        rest = [w for w in words if w not in self.cache]
        for w, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False) if rest else ()):
            self.cache[w] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: empty) as little-endian unsigned 32-bit integers. Words are cut and numbered by
        Arrow, so the cache is asked once per distinct word of the call, and ids are gathered as arrays."""
        if len(self.cache) > CACHED_WORDS:
            # Frequent words come early; the cache keeps its older part.
            self.cache = dict(islice(self.cache.items(), CACHED_WORDS * 4 // 5))
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        plain = pc.ascii_lower(texts) if self.lowers else texts
        odd = pc.or_(pc.match_substring_regex(texts, self.odd), pc.match_substring_regex(plain, self.odd))
        plain = pc.if_else(odd, "", plain)
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, _END_MARKS, r"\1 \2") if self.cuts else plain)
        coded = words.flatten().dictionary_encode()
        kinds, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        new = [w for w in kinds if w not in self.cache]
        if new:
            self._learn(new)
        found = list(map(self.cache.__getitem__, kinds))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table = np.frombuffer(b"".join(found), "<u4")
        n = sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = table[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n)]
        out = np.split(ids, ends[words.offsets.to_numpy() - words.offsets[0].as_py()][1:-1]) if len(texts) else []
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype="<u4")
        return out


class SharedEncoder:
    """A tokenizer to broadcast. A worker process builds its encoder once; the encoder and its word cache go
    with the broadcast value when the worker turns to other work, so they take no memory from later stages."""

    def __init__(self, tokenizer_json: str):
        self.tokenizer_json = tokenizer_json
        self.encoder: WordEncoder | None = None

    def __getstate__(self):
        return {**self.__dict__, "encoder": None}

    def get(self) -> WordEncoder:
        if self.encoder is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.encoder = WordEncoder(self.tokenizer_json)
        return self.encoder


def _write_shards(tokenizer, end_id: int, shard_tokens: int):
    end = struct.pack("<I", end_id)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer.value.get()
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        docs, sizes, data, held = [], [], [], 0

        def flush():
            nonlocal shard, before, held
            ids = np.frombuffer(b"".join(data), "<u4")
            row = [part], [shard], [before], [list(docs)], [list(sizes)], [len(ids)], [dac_encode(ids)]
            shard, before, held = shard + 1, before + len(ids), 0
            docs.clear(), sizes.clear(), data.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names)

        names = ["part", "shard", "before", "doc_ids", "sizes", "n_ids", "code"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(i, TEXTS_AT_ONCE)
                for doc, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1))):
                    docs.append(doc)
                    data.extend((ids, end))
                    sizes.append(len(ids) + 1)
                    held += sizes[-1]
                    if held >= shard_tokens:
                        yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the token ids of ``docs(doc_id, text)`` as shards at ``path`` in ascending ``doc_id`` order.

    Texts are range-partitioned by ``doc_id``; a hash of the text breaks ties, so many rows of one id
    still spread over partitions. Each task encodes its range in a stream and holds one shard. A null text
    is an empty one (only ``end_id``), a null ``doc_id`` sorts first, repeated rows are encoded each, an
    empty table gives an empty file set and further columns are ignored. ``tokenizer_path`` is read on the
    driver and broadcast (a tokenizer's size is fixed).
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(SharedEncoder(f.read()))
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    ranged = cols.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id")
    ranged.mapInArrow(_write_shards(tokenizer, end_id, shard_tokens), SHARD_SCHEMA).write.parquet(path)


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for i in range(batch.num_rows):
            base, before = batch.column(4)[i].as_py(), batch.column(0)[i].as_py()
            docs, sizes = batch.column(1)[i].values, batch.column(2)[i].values.to_numpy()
            data = DacReader(batch.column(3)[i].as_py()).decode().astype("<u4").tobytes()
            stops = np.cumsum(sizes)
            starts = stops - sizes
            crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
            arrays = [docs, pa.array(starts + (base + before)), pa.array(sizes), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The shards at ``path`` with ``base``, the number of ids in all files before a shard's own.

    One total per written file is gathered and broadcast: as many numbers as tasks wrote, not as rows.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    totals = sorted(shards.groupBy("part").agg(F.sum("n_ids")).collect())
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    return shards.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files at ``path``."""
    cols = read_tokens(spark, path).select("before", "doc_ids", "sizes", "code", "base")
    return cols.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token files (at ``path``, else in the scratch folder) and return their digest."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path)
    return token_digest(docs.sparkSession, path)
