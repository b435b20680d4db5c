"""Operator 6, token-id files: static range asymmetric numeral system (rANS) over independent interleaved blocks.

Layout of a data set under one path, all of it written and committed by Spark's writers, so that lost executors leave nothing
half done and any store works:

- `tables`: the shared frequency table, one row for each id that occurs: symbol, frequency; they add up to 2**SCALE. It is
  counted over the whole corpus and bounded by the vocabulary.
- `blocks`: one row for each block: shard, block, offset (ids of the shard before it), n_tokens, doc_ids, lengths, payload.
  Documents stand in ascending id order through the blocks of a shard and the shards, and never span two blocks.

A payload is little-endian: magic `RNS1`, ids (u32), lanes (u32), steps between checkpoints (u32), words (u32), CRC-32 of the
ids as u32 (u32), CRC-32 of all that follows (u32); then for each checkpoint its first word (u32) and the lanes' states (u64);
then the words (u32). Id i is in lane i mod lanes at step i div lanes. Decoding may start at any checkpoint, so blocks, and
the parts between checkpoints, decode in parallel; both checksums are verified.

Writing: texts are dealt by range of doc_id and sorted, tokenized, and written once as raw blocks; with how often each
id occurs in them; then each raw block is encoded where it lies. A document is encoded by pieces: the vocabulary's pre-tokenizer always
parts a text before a space that anything but white space follows, so each distinct piece is sent to the tokenizers library
when a worker first meets it, and kept in a bounded cache that knows it by all its bytes.

Defined results: a null or empty text is the end id alone; null ids come first; rows that repeat an id follow each other by
text; an empty table gives an empty data set; columns other than id and text are not read.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import arrow_map, arrow_schema, shared_path, slices, small_batches, table
from foliant.llm.hashing import Words

SCALE = 20
LANES = 4096
CHECKPOINT = 128
BLOCK = 1 << 20
END = 2
#: Slots of a worker's cache of pieces, as a power of two; five eighths of them are filled at most.
CACHE_BITS = 21
#: Bytes of a word that is looked up by its bytes in numpy arrays.
SHORT = 23
#: Longer words that a worker keeps, and the bytes of the longest of them.
MOST_LONG, LONGEST = 20_000, 256
#: Ids that a worker keeps at most before its cache starts anew.
MOST_IDS = 1 << 23
#: Bits of the three keys that a word of so many bytes fills.
_KEEP = np.array([[(1 << (8 * min(max(n - 8 * k, 0), 8))) - 1 for k in range(3)] for n in range(SHORT + 1)], np.uint64)
#: Characters of a text that are split at a time.
PART = 2_000_000
MAGIC = b"RNS1"
_LOW = np.uint64(1 << 31)
_U32, _U64 = np.uint64(32), np.uint64
_LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ʯ]+)([.,]?)")
#: Byte-level BPE writes each byte as a letter: bytes that aren't printable in Latin-1 as the letters from 256 on, in order.
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}
#: Only a space parts pieces.
BLANK = np.arange(256) == 32
_ODD_SPACE = re.compile(r" (?:\s|\Z)")


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of at least 1 for every id that occurs, adding up to 2**scale."""
    total, out = counts.sum(), np.zeros(len(counts), np.int64)
    if total == 0:
        return out
    some = counts > 0
    out[some] = np.maximum(1, np.floor(counts[some] * ((1 << scale) / total))).astype(np.int64)
    order, k = np.argsort(-out, kind="stable"), 0
    rest = (1 << scale) - int(out.sum())
    if rest > 0:
        out[order[0]] += rest
    while rest < 0:  # many rare ids were raised to 1: take from the most frequent
        take = min(-rest, int(out[order[k]]) // 2)
        out[order[k]] -= take
        rest, k = rest + take, (k + 1) % int(some.sum())
    return out


class Coder:
    """Encodes and decodes blocks with one frequency table."""

    def __init__(self, frequency: np.ndarray, scale: int = SCALE):
        self.scale = _U64(scale)
        self.frequency = frequency.astype(np.uint64)
        self.start = (np.cumsum(frequency) - frequency).astype(np.uint64)
        self.limit = self.frequency << _U64(63 - scale)
        self.symbol = np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency)

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = max(1, min(LANES, n // 32))
        steps = -(-n // lanes)
        x = np.full(lanes, _LOW)
        words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
        states = {}
        for s in range(steps - 1, -1, -1):
            part = ids[s * lanes : (s + 1) * lanes]
            y, f = x[: len(part)], self.frequency[part]
            out = y >= self.limit[part]
            if out.any():
                words[s] = y[out].astype(np.uint32)
                y = np.where(out, y >> _U32, y)
            q, r = np.divmod(y, f)
            x[: len(part)] = (q << self.scale) + r + self.start[part]
            if s % CHECKPOINT == 0:
                states[s] = x.copy()
        size = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.uint32)
        body = b"".join(struct.pack("<I", size[s]) + states[s].tobytes() for s in sorted(states)) + (np.concatenate(words).tobytes() if words else b"")
        return MAGIC + struct.pack("<6I", n, lanes, CHECKPOINT, int(size[-1]), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body

    def decode(self, payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of a block, or those from checkpoint `first` up to checkpoint `last`."""
        if payload[:4] != MAGIC:
            raise ValueError("not a block")
        n, lanes, every, n_words, crc, body_crc = struct.unpack_from("<6I", payload, 4)
        body = memoryview(payload)[28:]
        if zlib.crc32(body) != body_crc:
            raise ValueError("the block's checksum doesn't hold")
        steps = -(-n // lanes)
        marks = -(-steps // every)
        head = 4 + 8 * lanes
        words = np.frombuffer(body, "<u4", n_words, marks * head).astype(np.uint64)
        last = marks if last is None else min(last, marks)
        if first >= last:
            return np.zeros(0, np.uint32)
        at = struct.unpack_from("<I", body, first * head)[0]
        x = np.frombuffer(body, "<u8", lanes, first * head + 4).copy()
        stop = min(n, last * every * lanes)
        out = np.empty(stop - first * every * lanes, np.uint32)
        mask, p = _U64((1 << int(self.scale)) - 1), 0
        for s in range(first * every, min(steps, last * every)):
            k = min(lanes, n - s * lanes)
            y = x[:k]
            slot = y & mask
            symbol = self.symbol[slot]
            out[p : p + k] = symbol
            p += k
            y = self.frequency[symbol] * (y >> self.scale) + slot - self.start[symbol]
            low = np.flatnonzero(y < _LOW)
            y[low] = (y[low] << _U32) | words[at : at + len(low)]
            at += len(low)
            x[:k] = y
        if first == 0 and last == marks and zlib.crc32(out.astype("<u4").tobytes()) != crc:
            raise ValueError("the ids' checksum doesn't hold")
        return out


class Pieces:
    """Bounded cache from words to ids: open addressing over numpy arrays, looked up for all words of a batch at once.

    A word of up to SHORT bytes is known by these bytes and their number, three 64-bit keys; longer ones have a dictionary."""

    def __init__(self, dtype: np.dtype, bits: int = CACHE_BITS):
        self.dtype, self.bits = dtype, bits
        self.clear()

    def clear(self) -> None:
        slots = 1 << self.bits
        self.keys = np.zeros((slots, 3), np.uint64)
        self.start, self.n = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.ids, self.held, self.used = np.zeros(1 << 16, self.dtype), 0, 0
        self.long: dict[bytes, bytes] = {}

    @staticmethod
    def exact(w: Words, which: np.ndarray) -> np.ndarray:
        """The bytes of each word, filled up with zeros, and its length as the last byte; all words have 1 to SHORT bytes."""
        padded = np.concatenate([w.data, np.zeros(24, np.uint8)])
        windows = np.lib.stride_tricks.as_strided(padded, (len(padded) - 23, 24), (1, 1))
        start, size = w.start[which], w.end[which] - w.start[which]
        keys = np.ascontiguousarray(windows[start]).view(np.uint64)
        keys &= _KEEP[size]
        keys[:, 2] |= size.astype(np.uint64) << _U64(56)
        return keys

    def slots(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The slot of each word, or -1."""
        slot = (h >> _U64(64 - self.bits)).astype(np.int64)
        out, open_ = np.full(len(h), -1), np.arange(len(h))
        while len(open_):
            at = slot[open_]
            there, mine = self.keys[at], keys[open_]
            found = (there[:, 0] == mine[:, 0]) & (there[:, 1] == mine[:, 1]) & (there[:, 2] == mine[:, 2])
            out[open_[found]] = at[found]
            open_ = open_[~found & (there[:, 2] != 0)]  # the last key holds the length, never 0
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def hold(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each begin, now that they are held, and how many they are."""
        size = np.array([len(c) for c in coded], np.int64) // self.dtype.itemsize
        new = np.frombuffer(b"".join(coded), self.dtype)
        while self.held + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.held : self.held + len(new)] = new
        start = self.held + np.cumsum(size) - size
        self.held += len(new)
        return start, size

    def add(self, keys: np.ndarray, h: np.ndarray, coded: list[bytes]) -> None:
        """Distinct new words."""
        start, size = self.hold(coded)
        slot, open_ = (h >> _U64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(open_):
            free = open_[self.keys[slot[open_], 2] == 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            at = slot[won]
            self.keys[at], self.start[at], self.n[at] = keys[won], start[won], size[won]
            left = np.ones(len(h), bool)
            left[won] = False
            open_ = open_[left[open_]]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        self.used += len(h)

    def longer(self, words: list[bytes], encode) -> tuple[np.ndarray, np.ndarray]:
        """As __call__, of words of over SHORT bytes: the dictionary compares whole words."""
        new = [x for x in dict.fromkeys(words) if x not in self.long]
        fresh = dict(zip(new, encode([x.decode() for x in new]), strict=True))
        coded = [self.long.get(x) or fresh[x] for x in words]
        if len(self.long) + len(fresh) > MOST_LONG:
            self.long.clear()
        self.long |= {k: v for k, v in list(fresh.items())[:MOST_LONG] if len(k) <= LONGEST}
        return self.hold(coded)

    def __call__(self, w: Words, encode) -> tuple[np.ndarray, np.ndarray]:
        """First place in ids and number of ids of every word."""
        if self.held > MOST_IDS:
            self.clear()
        size = w.end - w.start
        short = size <= SHORT
        which = np.flatnonzero(short)
        keys, h = self.exact(w, which), w.hash[which]
        slot = self.slots(keys, h)
        missing = np.flatnonzero(slot < 0)
        raw = w.data.tobytes() if len(missing) or len(which) < len(size) else b""
        if len(missing):
            _, first = np.unique(keys[missing].view("V24").ravel(), return_index=True)
            new = missing[first]
            if self.used and self.used + len(new) > (1 << self.bits) * 5 // 8:
                self.clear()
                return self(w, encode)
            if len(new) > (1 << self.bits) * 5 // 8:  # one batch with more distinct words than the cache holds
                self.bits = len(new).bit_length() + 1
                self.clear()
            at = which[new]
            self.add(keys[new], h[new], encode([raw[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]))
            slot[missing] = self.slots(keys[missing], h[missing])
        start, n = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        start[which], n[which] = self.start[slot], self.n[slot]
        rest = np.flatnonzero(~short)
        if len(rest):
            start[rest], n[rest] = self.longer([raw[a:b] for a, b in zip(w.start[rest].tolist(), w.end[rest].tolist(), strict=True)], encode)
        return start, n


class Encoder:
    """Ids of texts as bytes, through the tokenizers library and a bounded cache of pieces."""

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.dtype = np.dtype(f"<u{self.width}")
        self.pieces = Pieces(self.dtype)
        self.marks = {c: self.tokenizer.token_to_id(c) for c in ".,"}
        self.end = array(self.code, [END]).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of a space and each word. A word of Latin letters, with a mark behind or none, is one or two pre-tokens and goes to the model itself."""
        tokenize, code, out, rest = self.tokenizer.model.tokenize, self.code, [b""] * len(words), []
        for k, w in enumerate(words):
            if m := _LETTERS.fullmatch(w):
                a = m[1]
                ids = [t.id for t in tokenize("Ġ" + (a if a.isascii() else a.encode().decode("latin-1").translate(_BYTE_LETTERS)))]
                if m[2]:
                    ids.append(self.marks[m[2]])
                out[k] = array(code, ids).tobytes()
            else:
                rest.append(k)
        for k, ids in zip(rest, self._plain([" " + words[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        ids = []
        for at in range(0, len(texts), 4096):
            ids += [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
        return ids

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        # a piece is a space and what follows it; a text with a space before white space or at its end is encoded as it is
        heads, owners, tails = [], [], []
        for k, t in enumerate(texts):
            head, space, tail = (t, "", "") if not t or _ODD_SPACE.search(t) else t.partition(" ")
            heads.append(head or "")
            while space:
                cut = tail.find(" ", PART) if len(tail) > PART else -1
                owners.append(k)
                tails.append(tail if cut < 0 else tail[:cut])
                space, tail = ("", "") if cut < 0 else (" ", tail[cut + 1 :])
        out = [[h] for h in self._plain(heads)]
        if tails:
            words = Words(pa.array(tails, pa.large_string()), BLANK)
            start, n = self.pieces(words, self._words)
            upto = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            flat = self.pieces.ids[np.repeat(start - upto[:-1], n) + np.arange(upto[-1])].tobytes()
            at = upto[words.first] * self.width
            for k, a, b in zip(owners, at[:-1].tolist(), at[1:].tolist(), strict=True):
                out[k].append(flat[a:b])
        return [b"".join([*x, self.end]) for x in out]


@lru_cache(maxsize=1)
def encoder(path: str | None) -> Encoder:
    """One for each Python worker, whose tasks share its cache."""
    return Encoder(path)


def raw_blocks(docs: DataFrame, path: str | None) -> DataFrame:
    """Blocks of plain ids: shard, block, offset, n_tokens, width, doc_ids, lengths, ids, counts (u32 of each id); in order of doc_id."""
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ddl = "shard int, block int, offset bigint, n_tokens bigint, width int, doc_ids array<bigint>, lengths array<int>, ids binary, counts binary"
    target = arrow_schema(docs.sparkSession, ddl)
    small_batches(docs.sparkSession)

    def run(batches):
        encode, shard = encoder(path), TaskContext.get().partitionId()
        width = encode.width
        ids, parts, held, block, offset = [], [], 0, 0, 0

        def flush():
            sizes = [len(p) // width for p in parts]
            # low and high bytes apart, which compresses better
            joined = b"".join(parts)
            plain = np.frombuffer(joined, np.uint8).reshape(-1, width).T.tobytes()
            counts = np.bincount(np.frombuffer(joined, encode.dtype)).astype("<u4").tobytes()
            return pa.RecordBatch.from_pydict({"shard": [shard], "block": [block], "offset": [offset], "n_tokens": [held], "width": [width], "doc_ids": [ids], "lengths": [sizes], "ids": [plain], "counts": [counts]}, schema=target)

        for batch in slices(batches, "text"):
            for doc_id, coded in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids.append(doc_id)
                parts.append(coded)
                held += len(coded) // width
                if held >= BLOCK:
                    yield flush()
                    block, offset, held, ids, parts = block + 1, offset + held, 0, [], []
        if ids:
            yield flush()

    return ordered.mapInArrow(run, ddl)


def plain_ids(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def write(docs: DataFrame, target: str, tokenizer_path: str | None = None) -> None:
    """Writes the data set of docs to target."""
    spark, raw_path = docs.sparkSession, shared_path(docs.sparkSession, "raw-blocks")
    raw = raw_blocks(docs, tokenizer_path)
    schema = raw.schema
    raw.write.option("compression", "zstd").parquet(raw_path)
    del raw
    release(spark)
    raw = spark.read.schema(schema).parquet(raw_path)

    def count():
        def f(batch):
            total = np.zeros(1, np.int64)
            for data in batch.column(0).to_pylist():
                c = np.frombuffer(data, "<u4").astype(np.int64)
                if len(c) > len(total):
                    c, total = total, c
                total[: len(c)] += c
            symbols = np.flatnonzero(total)
            return {"symbol": symbols, "n": total[symbols]}

        return f

    counts = arrow_map(raw.select("counts"), count, "symbol bigint, n bigint", "counts").groupBy("symbol").agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary
    release(spark)
    symbols, n = counts.column("symbol").to_numpy(), counts.column("n").to_numpy()
    total = np.zeros(int(symbols.max()) + 1 if len(symbols) else 1, np.int64)
    total[symbols] = n
    frequency = frequencies(total)
    rows = [(int(s), int(frequency[s])) for s in np.flatnonzero(frequency)]
    spark.createDataFrame(rows, "symbol int, frequency int").coalesce(1).write.parquet(f"{target}/tables")

    def encode():
        coder = Coder(frequency)

        def f(batch):
            widths = batch.column(batch.schema.names.index("width")).to_pylist()
            coded = [coder.encode(plain_ids(d, w)) for d, w in zip(batch.column(batch.schema.names.index("ids")).to_pylist(), widths, strict=True)]
            return {c: batch.column(batch.schema.names.index(c)) for c in ("shard", "block", "offset", "n_tokens", "doc_ids", "lengths")} | {"payload": coded}

        return f

    ddl = "shard int, block int, offset bigint, n_tokens bigint, doc_ids array<bigint>, lengths array<int>, payload binary"
    arrow_map(raw.drop("counts"), encode, ddl, "ids").write.option("compression", "none").parquet(f"{target}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of a data set: doc_id, start, n_tokens, ids_crc32, ids (u32, little-endian)."""
    rows = spark.read.schema("symbol int, frequency int").parquet(f"{path}/tables").collect()  # at most the vocabulary
    frequency = np.zeros(max((r.symbol for r in rows), default=0) + 1, np.int64)
    for r in rows:
        frequency[r.symbol] = r.frequency
    blocks = spark.read.schema("shard int, block int, offset bigint, n_tokens bigint, doc_ids array<bigint>, lengths array<int>, payload binary").parquet(f"{path}/blocks")
    before, base = 0, {}
    for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():  # one row for each shard
        base[r.shard], before = before, before + r.n

    def make():
        coder = Coder(frequency)

        def f(batch):
            out = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", "ids")}
            for shard, offset, ids, lengths, payload in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                tokens, at = coder.decode(payload), 0
                for doc_id, n in zip(ids, lengths, strict=True):
                    part = tokens[at : at + n].astype("<u4").tobytes()
                    for k, v in zip(out, (doc_id, base[shard] + offset + at, n, zlib.crc32(part), part), strict=True):
                        out[k].append(v)
                    at += n
            return out

        return f

    return arrow_map(blocks.select("shard", "offset", "doc_ids", "lengths", "payload"), make, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary", "payload", 1_000_000)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    write(table(spark, sf_dir, "documents"), target := shared_path(spark, "token-files"))
    return read(spark, target).drop("ids")


QUERIES = {"op6_token_files": op6_token_files}
SQL: dict[str, str] = {}
