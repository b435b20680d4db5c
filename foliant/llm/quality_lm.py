"""Operator 9, quality classifier: interpolated modified Kneser-Ney trigram model and language-specific quantiles.

The model counts every trusted labelled document (quality 1, not toxic) of the training fold, half of the ids by hash, whole;
all other trusted documents are held out and give the quantiles. So model and thresholds grow with the corpus. N-grams are
counted in shards, over numbered words; only arrays over the vocabulary (words that the fold has twice or more) are gathered
and broadcast.

`score_by_shards` deals trigrams by their middle word, the trained ones and those to be scored alike: in its shard a trigram meets
all that its probability needs but the unigrams. Trigrams around a word that is more frequent than a shard is large are dealt
into parts by the word before as well; the word's bigrams, few beside them, go to all of its parts. Each batch of documents
sends a shard its distinct trigrams once, sorted and packed, with the documents that hold them, and gets back a sum for
each document, in fixed point of 18 binary places, so that sums don't depend on their order. `score` gives the same by a
broadcast `Model` and `score_by_joins` by joins, for models that are small.

Words outside the vocabulary are mapped to a class of their form (lower case, capital, digits, symbols, mixed, repeat of the
word before), as their spelling tells nothing. A document is kept if its log perplexity is at most the `quantile` of those of
the held-out documents of its language and of about its length (LENGTHS), all of them; a short text is thus held against short
texts, whose perplexities spread more. Where fewer than `support` such documents are known, those of that length in all
languages count, then those of the language, then all. The quantile is read from an exact histogram with bins of 1/1000.

Defined results: a text that is null or has no word has no perplexity and is rejected; a null language is a language of its
own; where there is no trusted document at all nothing with a word is rejected; a null id is scored as any other; repeated
rows each give a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import MAX_BROADCAST_ROWS, arrow_map, arrow_schema, digest, maybe_broadcast, slices, stored, table, trimmed
from foliant.llm.hashing import SPACE, U, Words, chain, mix

ORDER = 3
#: Hashes of the start mark and of the classes of words outside the vocabulary.
START = mix(np.array([1], U))[0]
CLASSES = mix(np.arange(11, 17, dtype=U))
LOWERCASE, CAPITAL, DIGITS, SYMBOLS, MIXED, REPEAT = range(6)
BIN = 1000
#: Words from which on a document is of the next class of length.
LENGTHS = (32, 128, 512)
#: One in the fixed-point numbers of the sharded model.
ONE = 1 << 18
#: Words of the training texts for each shard, about, and shards at least.
SHARD_TOKENS, MIN_SHARDS = 1 << 19, 64
#: Bytes of text whose n-grams are dealt at a time, and rows of bigrams.
REQUEST_BYTES, PAIR_ROWS = 4_000_000, 100_000
#: First bits of a word's hash by which words are counted together, and so many numbered words of which contexts are.
WORD_RANGES, NUMBERS = 8, 1 << 14

_SYMBOL = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
_DIGIT = np.array([48 <= c < 58 for c in range(256)])
_UPPER = np.array([65 <= c < 91 for c in range(256)])
_STOP = np.array([chr(c) in ".,;:!?)\"'" for c in range(256)])


def classes(w: Words) -> np.ndarray:
    """The class of each word, were it outside the vocabulary."""
    count = lambda flag: np.concatenate([[0], np.cumsum(flag[w.data], dtype=np.int32)])
    symbols, digits = count(_SYMBOL), count(_DIGIT)
    length = w.end - w.start
    n_symbols = symbols[w.end] - symbols[w.start]
    last = w.data[w.end - 1]
    n_inner = n_symbols - (_STOP[last] & (length > 1))
    n_digits = digits[w.end] - digits[w.start]
    out = np.where(_UPPER[w.data[w.start]], CAPITAL, LOWERCASE)
    out[n_inner > 0] = MIXED
    out[n_digits > 0] = DIGITS
    out[n_symbols == length] = SYMBOLS
    same = np.zeros(len(out), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc()[1:] == w.doc()[:-1])
    out[same] = REPEAT
    return out


class Lookup:
    """Sorted keys and the values at them."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def __call__(self, q: np.ndarray, default: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(q), default, np.float32)
        i = np.searchsorted(self.keys, q)
        i[i == len(self.keys)] = 0
        return np.where(self.keys[i] == q, self.values[i], np.float32(default))


def symbols(w: Words, vocabulary: np.ndarray) -> np.ndarray:
    """Hash of each word, or of its class if it isn't in the sorted vocabulary."""
    if len(vocabulary):
        i = np.searchsorted(vocabulary, w.hash)
        i[i == len(vocabulary)] = 0
        known = vocabulary[i] == w.hash
    else:
        known = np.zeros(len(w.hash), bool)
    kind = classes(w)
    return np.where(known & (kind != REPEAT), w.hash, CLASSES[kind])


def contexts(h: np.ndarray, w: Words, start=START) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two before each."""
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    place = np.arange(len(h)) - np.repeat(w.first[:-1], np.diff(w.first))
    one[place < 1] = start
    two[place < 2] = start
    return one, two


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


class Model:
    """Broadcast tables: vocabulary, weight of the n-gram itself, and the share that each context gives to the lower order."""

    def __init__(self, vocabulary, tri, ctx2, bi, ctx1, uni, floor: float):
        self.vocabulary, self.floor = vocabulary, floor
        self.tri, self.ctx2, self.bi, self.ctx1, self.uni = (Lookup(*x) for x in (tri, ctx2, bi, ctx1, uni))

    def log_probabilities(self, w: Words) -> np.ndarray:
        h = symbols(w, self.vocabulary)
        one, two = contexts(h, w)
        p = self.uni(signed(h), self.floor)
        p = self.bi(signed(chain([one, h])), 0.0) + self.ctx1(signed(one), 1.0) * p
        p = self.tri(signed(chain([two, one, h])), 0.0) + self.ctx2(signed(chain([two, one])), 1.0) * p
        return np.log(np.maximum(p, 1e-12, dtype=np.float64))

    def perplexity(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Log perplexity and number of words of each text."""
        w = Words(column, SPACE)
        n = np.diff(w.first)
        total = np.concatenate([[0.0], np.cumsum(self.log_probabilities(w))]) if len(w.hash) else np.zeros(1)
        return -(total[w.first[1:]] - total[w.first[:-1]]) / np.maximum(n, 1), n


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    d = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.1 * k), 0.95 * k) for k, x in enumerate(d, 1))


def _discounts(counts: DataFrame, column: str) -> tuple[float, float, float]:
    of = {int(r[0]): int(r[1]) for r in counts.where(F.col(column) <= 4).groupBy(column).count().collect()}
    return discounts([of.get(k, 0) for k in (1, 2, 3, 4)])


def _level(counts: DataFrame, context: str, count: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, weight of the n-gram itself) and (context, share of the lower order)."""
    d1, d2, d3 = _discounts(counts, count)
    c = F.col(count)
    discount = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
    totals = counts.groupBy(context).agg(F.sum(c).alias("total"), F.sum(discount).alias("free"))
    own = counts.join(totals, context).select(F.col(key).alias("key"), (F.greatest(c - discount, F.lit(0.0)) / F.col("total")).cast("float").alias("value"))
    return own, totals.select(F.col(context).alias("key"), (F.col("free") / F.col("total")).cast("float").alias("value"))


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.toArrow()
    return t.column("key").to_numpy().astype(np.int64), t.column("value").to_numpy().astype(np.float32)


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return list(zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=False))


def word_counts(texts: DataFrame, text_col: str = "text") -> pa.Table:
    """w (hash), c of the words that occur twice or more, and rows with null as w, whose c together are the number of all words."""

    def count_words():
        def f(batch):
            pieces = [Words(x.column(0)).hash for x in slices(iter([batch]), text_col)]
            h, c = np.unique(np.concatenate(pieces), return_counts=True)
            of = h >> U(64 - WORD_RANGES)
            ends = runs(of)
            return {"range": [int(of[a]) for a, _ in ends], "data": [packed_rows(h[a:b] & U((1 << 64 - WORD_RANGES) - 1), c[a:b]) for a, b in ends]}

        return f

    def summed(t: pa.Table) -> pa.Table:
        h, c = joined(t.column("data").to_pylist(), np.int64, np.int64)
        h, place = np.unique(h, return_inverse=True)
        c = np.bincount(place, c).astype(np.int64)
        h = signed(h.astype(U) | U(t.column("range")[0].as_py() << 64 - WORD_RANGES))
        w = pa.array(np.append(h[c > 1], 0), mask=np.arange((c > 1).sum() + 1) == (c > 1).sum())
        return pa.table({"w": w, "c": np.append(c[c > 1], c.sum())})

    parts = arrow_map(texts.select(text_col), count_words, "range int, data binary", text_col, REQUEST_BYTES)
    return parts.groupBy("range").applyInArrow(lambda t: trimmed(summed(t)), "w bigint, c bigint").toArrow()


def vocabulary_of(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the words that occur twice or more."""
    return np.sort(word_counts(texts, text_col).column("w").drop_null().to_numpy().astype(np.int64).view(U))


GRAM = "key bigint, ctx2 bigint, key2 bigint, ctx1 bigint, word bigint"


def grams_of(w: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, dict]:
    """Symbol of every word, and the columns of GRAM."""
    h = symbols(w, vocabulary)
    one, two = contexts(h, w)
    return h, {"key": signed(chain([two, one, h])), "ctx2": signed(chain([two, one])), "key2": signed(chain([one, h])), "ctx1": signed(one), "word": signed(h)}


def tables_of(texts: DataFrame, vocabulary: np.ndarray, text_col: str = "text") -> tuple[dict[str, DataFrame], float]:
    """key and value of each part of the model: own3, ctx2, own2, ctx1, uni; and the share of a word that was never seen."""

    def count_grams():
        def f(batch):
            h, columns = grams_of(Words(batch.column(0)), vocabulary)
            use = h != CLASSES[REPEAT]  # a repeated word is never made likely, however often it is seen
            key, at, c = np.unique(columns["key"][use], return_index=True, return_counts=True)
            return {k: v[use][at] for k, v in columns.items()} | {"c": c}

        return f

    tri = arrow_map(texts.select(text_col), count_grams, GRAM + ", c bigint", text_col)
    tri = stored(tri.groupBy("key", "ctx2", "key2", "ctx1", "word").agg(F.sum("c").alias("c")), "trigrams")
    bi = stored(tri.groupBy("key2", "ctx1", "word").agg(F.count("*").alias("n")), "bigrams")
    own3, ctx2 = _level(tri, "ctx2", "c", "key")
    own2, ctx1 = _level(bi, "ctx1", "n", "key2")
    # the lowest order interpolates with the uniform distribution over vocabulary and classes
    uni = bi.groupBy("word").agg(F.count("*").alias("n"))
    total, held = uni.agg(F.sum("n"), F.sum(F.least(F.col("n").cast("double"), F.lit(0.75)))).head()
    size = len(vocabulary) + len(CLASSES)
    rest = held / total if total else 1.0
    value = (F.col("n") - F.least(F.col("n").cast("double"), F.lit(0.75))) / float(total or 1) + rest / size
    return {"own3": own3, "ctx2": ctx2, "own2": own2, "ctx1": ctx1, "uni": uni.select(F.col("word").alias("key"), value.cast("float").alias("value"))}, float(rest / size)


def train(texts: DataFrame, text_col: str = "text") -> Model:
    """The model of the given, bounded texts."""
    vocabulary = vocabulary_of(texts, text_col)
    tables, floor = tables_of(texts, vocabulary, text_col)
    return Model(vocabulary, *(_arrays(tables[k]) for k in ("own3", "ctx2", "own2", "ctx1", "uni")), floor)


def trusted(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of labelled documents of quality 1 that aren't toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct()


def training_texts(docs: DataFrame, labels: DataFrame, max_train: int | None = None, max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The texts that are counted and their ids: all of one fold of the trusted ids, so that the others are held out.

    With bounds, of the fold's texts that are short enough at most so many, in turn from each language."""
    fold = trusted(labels).where(F.xxhash64("doc_id", F.lit("fold")) % 2 == 0)
    docs = docs if max_chars is None else docs.where(F.length("text") <= max_chars)
    if max_train is None:
        few = fold.count() <= MAX_BROADCAST_ROWS
        texts = docs.select("doc_id", "text").join(F.broadcast(fold) if few else fold, "doc_id").select("text")
        return texts if few else stored(texts, "trusted"), fold  # read twice
    known = docs.select("doc_id", "lang").join(maybe_broadcast(fold), "doc_id").dropDuplicates(["doc_id"])
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    sample = known.withColumn("turn", turn).where(F.col("turn") <= max_train).orderBy("turn", F.xxhash64("doc_id"), "doc_id").limit(max_train).select("doc_id")
    sample = stored(sample, "sample")  # at most max_train ids
    return stored(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text"), "trusted"), sample


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length and of numbers from 0 on: the numbers' lengths in bits, compressed, and their bits below the first, place by place."""
    out = [len(columns[0]).to_bytes(8, "little")]
    for x in (x.astype(np.int64) for x in columns):
        bits = np.frexp(x.astype(np.float64))[1].astype(np.uint8)
        bits -= (bits > 0) & (x >> np.maximum(bits, 1).astype(np.int64) - 1 == 0)  # where the float was rounded up
        coder = zlib.compressobj(9, zlib.DEFLATED, -15, 9, zlib.Z_RLE)
        lengths = coder.compress(bits.tobytes()) + coder.flush()
        out += [len(lengths).to_bytes(8, "little"), lengths]
        out += [np.packbits((x[bits > k + 1] >> k & 1).astype(np.uint8)).tobytes() for k in range(int(bits.max(initial=0)) - 1)]
    return b"".join(out)


def unpacked(data: bytes, *types: type) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for t in types:
        end = at + 8 + int.from_bytes(data[at : at + 8], "little")
        bits, at = np.frombuffer(zlib.decompress(data[at + 8 : end], -15), np.uint8), end
        x = np.where(bits > 0, np.int64(1) << np.maximum(bits, 1).astype(np.int64) - 1, 0)
        for k in range(int(bits.max(initial=0)) - 1):
            on = np.flatnonzero(bits > k + 1)
            end = at + -(-len(on) // 8)
            x[on] |= np.unpackbits(np.frombuffer(data[at:end], np.uint8), count=len(on)).astype(np.int64) << k
            at = end
        out.append(x.astype(t))
        assert len(x) == n
    return out


def packed_rows(*columns: np.ndarray) -> bytes:
    """Rows in order of all columns but the last, which is a count from 1 on. A number is given by its distance from that in the row before, where the columns before it are the same."""
    same, out = np.arange(len(columns[0])) > 0, []
    for x in (x.astype(np.int64) for x in columns[:-1]):
        out.append(np.where(same, np.diff(x, prepend=0), x))
        same = same & (out[-1] == 0)
    return packed(*out, columns[-1].astype(np.int64) - 1)


def unpacked_rows(data: bytes, *types: type) -> list[np.ndarray]:
    *columns, count = unpacked(data, *[np.int64] * len(types))
    new, out = np.arange(len(count)) == 0, []
    for x in columns:
        total, at = np.cumsum(x), np.flatnonzero(new)
        out.append(total - np.repeat(total[at] - x[at], np.diff(np.append(at, len(x)))))
        new = new | (x != 0)
    return [x.astype(t) for x, t in zip((*out, count + 1), types, strict=True)]


def joined(blobs: list[bytes], *types: type) -> list[np.ndarray]:
    parts = [unpacked_rows(x, *types) for x in blobs]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in types]


I32, COUNT, DOC = np.int32, np.uint32, np.uint16
#: Columns of trigrams (the middle word first, by which they are sharded), of a batch's and of bigrams.
TRIGRAM, ASKED, BIGRAM = (I32, I32, I32, COUNT), (I32, DOC, I32, I32, COUNT), (I32, I32, COUNT)


@dataclass
class Vocabulary:
    """The known words, and how trigrams are dealt. A word's number is the more frequent the smaller; first come the classes and START."""

    words: np.ndarray
    number: np.ndarray
    #: Into how many parts, by the word before, the trigrams around each symbol are dealt.
    parts: np.ndarray
    bits: int

    def __getstate__(self) -> tuple:
        return packed_rows(self.words >> U(32), self.words & U(0xFFFFFFFF), self.number), packed(self.parts), self.bits

    def __setstate__(self, state: tuple) -> None:
        high, low, self.number = unpacked_rows(state[0], U, U, np.int64)
        self.words, (self.parts,), self.bits = high << U(32) | low, unpacked(state[1], np.int32), state[2]

    def numbers(self, w: Words) -> np.ndarray:
        kind = classes(w)
        if not len(self.words):
            return kind.astype(np.int64)
        i = np.minimum(np.searchsorted(self.words, w.hash), len(self.words) - 1)
        return np.where((self.words[i] == w.hash) & (kind != REPEAT), self.number[i], kind)

    def trigrams(self, w: Words) -> tuple[np.ndarray, ...]:
        """The middle symbol, the one before and the one after it, for each word of the texts as the last."""
        h = self.numbers(w)
        v, u = contexts(h, w, len(CLASSES))
        return v, u, h

    def trigrams_of(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Number of words of each text; then trigrams and the text of each, numbered from little text at a time."""
        parts, start = [], 0
        for piece in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text"):
            w = Words(piece.column(0))
            parts.append((np.diff(w.first), *self.trigrams(w), w.doc() + start))
            start += piece.num_rows
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def shards(self, v: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (mix((v << 20 | part).astype(U)) >> U(64 - self.bits)).astype(np.int64)

    def dealt(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, doc: np.ndarray) -> list[tuple[int, tuple[np.ndarray, ...]]]:
        """Each shard that has some, and its distinct rows by (v, doc, u, w) with their counts."""
        if not len(v):
            return []
        parts = self.parts[v]
        shard = self.shards(v, np.where(parts > 1, (mix(u.astype(U)) % parts.astype(U)).astype(np.int64), 0))
        order = np.lexsort((u << 32 | w, doc, shard << 32 | v))
        shard, v, u, w, doc = (x[order] for x in (shard, v, u, w, doc))
        at = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in (v, u, w, doc)], axis=0)))
        columns = [x[at].astype(t) for x, t in zip((v, doc, u, w), ASKED, strict=False)] + [np.diff(np.append(at, len(v))).astype(COUNT)]
        shard = shard[at]
        starts = np.flatnonzero(np.diff(shard, prepend=-1))
        return [(int(shard[a]), tuple(x[a:b] for x in columns)) for a, b in zip(starts, np.append(starts[1:], len(shard)), strict=True)]


def bigrams(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (v, w), by both, and the sums of n."""
    key, place = np.unique(v.astype(np.int64) << 32 | w, return_inverse=True)
    return key >> 32, key & 0xFFFFFFFF, np.bincount(place, n, len(key)).astype(np.int64)


def counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist()


def numbered_words(texts: DataFrame, text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> Vocabulary:
    """The vocabulary of all the given texts."""
    t = word_counts(texts, text_col)
    total = int(pc.sum(t.filter(pc.is_null(t.column("w"))).column("c")).as_py() or 0)
    t = t.drop_null()
    words, counts = t.column("w").to_numpy().astype(np.int64).view(U), t.column("c").to_numpy().astype(np.int64)
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    once, first = total - int(counts.sum()), len(CLASSES) + 1
    number = np.empty(len(words), np.int64)
    number[np.argsort(-counts, kind="stable")] = np.arange(first, first + len(words))
    seen = np.full(first + len(words), once)  # no class has more words than are outside the vocabulary, but for repeats
    seen[number] = counts
    bits = int(np.ceil(np.log2(max(MIN_SHARDS, total / shard_tokens))))
    return Vocabulary(words, number, np.minimum(1 << 20, -(-seen // shard_tokens)).clip(1).astype(np.int32), bits)


@dataclass
class Shards:
    """A model whose n-grams stay sharded by their middle words."""

    vocabulary: Broadcast[Vocabulary]
    #: Discounts of trigrams and bigrams, and probability of each symbol on its own: the distinct ones, and which of them it is.
    tri: tuple[float, float, float]
    bi: tuple[float, float, float]
    alone: Broadcast[tuple[np.ndarray, bytes]]
    #: shard, trigrams, bigrams (of middle symbols that are dealt into parts), both packed.
    counts: DataFrame


def train_shards(texts: DataFrame, text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> Shards:
    """The model of all the given texts, however many."""
    spark = texts.sparkSession
    vocabulary = numbered_words(texts, text_col, shard_tokens)
    shared = spark.sparkContext.broadcast(vocabulary)

    def deal():
        voc = shared.value

        def f(batch):
            _, v, u, w, _ = voc.trigrams_of(batch.column(0))
            use = w != REPEAT  # a repeated word is never made likely, however often it is seen
            out = voc.dealt(v[use], u[use], w[use], np.zeros(use.sum(), np.int64))
            return {"shard": [k for k, _ in out], "trigrams": [packed_rows(v, u, w, c) for _, (v, _, u, w, c) in out]}

        return f

    def total_of(t: pa.Table) -> pa.Table:
        w, n = joined(t.column("alone").to_pylist(), I32, np.int64)
        w, place = np.unique(w, return_inverse=True)
        return pa.table({"w": w, "n": np.bincount(place, n).astype(np.int64)})

    def count(t: pa.Table) -> pa.Table:
        parts = shared.value.parts
        v, u, w, c = joined(t.column("trigrams").to_pylist(), *TRIGRAM)
        order = np.lexsort((u.astype(np.int64) << 32 | w, v))
        v, u, w, c = (x[order] for x in (v, u, w, c))
        at = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1])))
        v, u, w, c = v[at], u[at], w[at], np.add.reduceat(c.astype(np.int64), at)
        b, x, n = bigrams(v, w, np.ones(len(v)))
        split = parts[b] > 1  # their bigrams are in other shards too
        alone, of = np.unique(x[~split], return_counts=True)
        ends = runs(alone // NUMBERS)
        row = {"shard": t.column("shard")[0].as_py(), "trigrams": packed_rows(v, u, w, c), "split": packed_rows(b[split], x[split], n[split])}
        row |= {"tri": counts_of_counts(c), "bi": counts_of_counts(n[~split]), "range": [int(alone[a]) // NUMBERS for a, _ in ends], "alone": [packed_rows(alone[a:b], of[a:b]) for a, b in ends]}
        return pa.Table.from_pylist([row], schema=counted)

    schema = "shard int, trigrams binary, split binary, tri array<bigint>, bi array<bigint>, range array<int>, alone array<binary>"
    counted = arrow_schema(spark, schema)
    dealt = arrow_map(texts.select(text_col), deal, "shard int, trigrams binary", text_col, REQUEST_BYTES)
    counts = stored(dealt.groupBy("shard").applyInArrow(lambda t: trimmed(count(t)), schema), "counts")
    unigrams = counts.select(F.explode(F.arrays_zip("range", "alone")).alias("x")).select("x.range", "x.alone")
    unigrams = [unigrams.groupBy("range").applyInArrow(total_of, "w int, n bigint")]
    of_tri, of_bi = ([counts.agg(*(F.coalesce(F.sum(F.get(level, F.lit(k))), F.lit(0)) for k in range(4))).head()[k] for k in range(4)] for level in ("tri", "bi"))
    model = counts.select("shard", "trigrams", F.lit(b"").alias("bigrams"))
    if (vocabulary.parts > 1).any():
        pairs = stored(_split_bigrams(counts), "split-bigrams")
        of = {int(r[0]): int(r[1]) for r in pairs.where("n <= 4").groupBy("n").count().collect()}
        of_bi = [x + of.get(k, 0) for k, x in enumerate(of_bi, 1)]
        unigrams.append(pairs.groupBy("w").agg(F.count("*").alias("n")))
        model = model.unionByName(_replicated(pairs, shared))
    # the lowest order interpolates with the uniform distribution over vocabulary and classes
    size = len(vocabulary.words) + len(CLASSES)
    seen = np.zeros(size + 1)
    for t in (x.toArrow() for x in unigrams):
        seen[t.column("w").to_numpy()] += t.column("n").to_numpy()
    total = seen.sum()
    alone = (np.minimum(seen, 0.75).sum() / total if total else 1.0) / size + (seen - np.minimum(seen, 0.75)) / (total or 1.0)
    values, place = np.unique(alone, return_inverse=True)
    return Shards(shared, discounts(of_tri), discounts(of_bi), spark.sparkContext.broadcast((values, packed(place))), model)


def _split_bigrams(counts: DataFrame) -> DataFrame:
    """v, w, n of the bigrams whose middle symbols are dealt into parts, n over all parts."""

    def rows():
        def f(batch):
            v, w, n = joined(batch.column(0).to_pylist(), *BIGRAM)
            return {"v": v, "w": w, "n": n.astype(np.int64)}

        return f

    return arrow_map(counts.select("split"), rows, "v int, w int, n bigint", "split").groupBy("v", "w").agg(F.sum("n").alias("n"))


def _replicated(pairs: DataFrame, shared) -> DataFrame:
    """shard, trigrams (none), bigrams: the pairs for every part of their first symbol."""

    def deal(batches):
        voc, waiting, rows = shared.value, [], 0

        def cut():
            v, w, n = (pa.concat_arrays(x).to_numpy().astype(t) for x, t in zip(zip(*waiting, strict=True), (np.int64, I32, COUNT), strict=True))
            order = np.lexsort((w, v))
            v, w, n = v[order], w[order], n[order]
            times = voc.parts[v].astype(np.int64)
            row = np.repeat(np.arange(len(v)), times)
            shard = voc.shards(v[row], np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times))
            shard, row = np.unique(np.stack([shard, row]), axis=1)  # two parts may be in one shard
            at = np.flatnonzero(np.diff(shard, prepend=-1))
            blobs = [packed_rows(v[row[a:b]], w[row[a:b]], n[row[a:b]]) for a, b in zip(at, np.append(at[1:], len(shard)), strict=True)]
            return pa.RecordBatch.from_pydict({"shard": shard[at], "trigrams": [b""] * len(at), "bigrams": blobs}, schema=target)

        for batch in batches:
            waiting.append(batch.columns)
            rows += batch.num_rows
            if rows >= PAIR_ROWS:
                yield cut()
                waiting, rows = [], 0
        if rows:
            yield cut()

    schema = "shard int, trigrams binary, bigrams binary"
    target = arrow_schema(pairs.sparkSession, schema)
    return pairs.select("v", "w", "n").mapInArrow(deal, schema)


class Shard:
    """The n-grams around some middle symbols."""

    def __init__(self, trigrams: list[bytes], more: list[bytes], parts: np.ndarray, tri: tuple, bi: tuple):
        v, u, w, c = joined(trigrams, *TRIGRAM)  # of one shard, sorted
        b, x, n = bigrams(v, w, np.ones(len(v)))
        split = parts[b] > 1
        b, x, n = (np.concatenate([y[~split], z]).astype(np.int64) for y, z in zip((b, x, n), joined(more, *BIGRAM), strict=True))
        order = np.lexsort((x, b))
        b, x, n = b[order], x[order], n[order]
        cut = lambda k, d: np.asarray(d)[np.minimum(k, 3) - 1] if len(k) else np.zeros(0)
        self.v, of = np.unique(b, return_inverse=True)
        total, free = np.bincount(of, n, len(self.v)), cut(n, bi)
        self.two, self.own2 = of << 32 | x, (n - free) / total[of]
        self.share1 = np.bincount(of, free, len(self.v)) / total
        self.context, of = np.unique(np.searchsorted(self.v, v) << 32 | u, return_inverse=True)
        c = c.astype(np.int64)
        total, free = np.bincount(of, c, len(self.context)), cut(c, tri)
        self.three, self.own3 = of << 32 | w, (c - free) / total[of]
        self.share2 = np.bincount(of, free, len(self.context)) / total

    def log_probabilities(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, alone: np.ndarray) -> np.ndarray:
        p = alone[w]
        if len(self.v):
            i, known = found(self.v, v)
            p = np.where(known, self.share1[i], 1.0) * p
            k, seen = found(self.two, i << 32 | w)
            p += np.where(known & seen, self.own2[k], 0.0)
            i, seen = found(self.context, i << 32 | u)
            known &= seen
            p *= np.where(known, self.share2[i], 1.0) if len(self.context) else 1.0
            k, seen = found(self.three, i << 32 | w)
            p += np.where(known & seen, self.own3[k], 0.0) if len(self.three) else 0.0
        return np.log(np.clip(p, 1e-12, 1.0))


def found(keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each number among the sorted keys, and whether it is there."""
    i = np.minimum(np.searchsorted(keys, q), max(len(keys) - 1, 0))
    return i, keys[i] == q if len(keys) else np.zeros(len(q), bool)


def score_by_shards(docs: DataFrame, model: Shards, carried: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The carried columns, n_words and log_perplexity (null without words) of every document."""
    shared, alone, discounted = model.vocabulary, model.alone, (model.tri, model.bi)

    def ask():
        voc = shared.value

        def f(batch):
            words, *trigrams = voc.trigrams_of(batch.column(1))
            first, out = batch.column(0)[0].as_py(), voc.dealt(*trigrams)
            # the documents themselves travel as one more row, by any shard
            rows = [dict(zip(carried, x, strict=True)) for x in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            n = len(out)
            return {
                "batch": [first] * (n + 1),
                "shard": [first % 1_000_003 % (1 << voc.bits), *(k for k, _ in out)],
                "data": [packed(words), *(packed_rows(*columns) for _, columns in out)],
                "rows": [rows] + [None] * n,
            }

        return f

    def answer(asked: pa.Table, counts: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return answered.empty_table()
        shard = Shard(*([x for x in counts.column(k).to_pylist() if x] for k in ("trigrams", "bigrams")), shared.value.parts, *discounted)
        values, place = alone.value
        own, data = values[unpacked(place, I32)[0]], []
        for x, rows in zip(asked.column("data"), asked.column("rows"), strict=True):
            if rows.is_valid:
                data.append(x.as_py())
                continue
            v, doc, u, w, c = unpacked_rows(x.as_py(), *ASKED)
            logs = np.rint(shard.log_probabilities(v, u, w, own) * -ONE).astype(np.int64) * c
            which, place = np.unique(doc, return_inverse=True)
            total = np.zeros(len(which), np.int64)
            np.add.at(total, place, logs)
            data.append(packed_rows(which, total + 1))
        return pa.Table.from_arrays([asked.column("batch"), pa.array(data, pa.binary()), asked.column("rows")], schema=answered)

    def total(parts: pa.Table) -> pa.Table:
        for x, own in zip(parts.column("data"), parts.column("rows"), strict=True):
            if own.is_valid:
                rows, (n,) = own.as_py(), unpacked(x.as_py(), np.int64)
        sums = np.zeros(len(n), np.int64)
        for x, own in zip(parts.column("data"), parts.column("rows"), strict=True):
            if not own.is_valid:
                which, logs = unpacked_rows(x.as_py(), DOC, np.int64)
                sums[which] += logs - 1
        logs = pa.array(sums / ONE / np.maximum(n, 1), mask=n == 0)
        return pa.Table.from_pydict({c: [x[c] for x in rows] for c in carried} | {"n_words": n, "log_perplexity": logs}, schema=scored)

    types = {c: docs.schema[c].dataType.simpleString() for c in carried}
    tail = f"data binary, rows array<struct<{', '.join(f'{c}: {t}' for c, t in types.items())}>>"
    result = ", ".join(f"{c} {t}" for c, t in types.items()) + ", n_words bigint, log_perplexity double"
    answered, scored = arrow_schema(docs.sparkSession, f"batch bigint, {tail}"), arrow_schema(docs.sparkSession, result)
    asked = docs.select(F.monotonically_increasing_id().alias("batch"), "text", *carried)
    asked = arrow_map(asked, ask, f"batch bigint, shard int, {tail}", limit=REQUEST_BYTES)
    answers = asked.groupBy("shard").cogroup(model.counts.groupBy("shard")).applyInArrow(lambda asked, counts: trimmed(answer(asked, counts)), f"batch bigint, {tail}")
    return answers.groupBy("batch").applyInArrow(lambda parts: trimmed(total(parts)), result)


def length_class(n: Column) -> Column:
    return sum(((n >= k).cast("int") for k in LENGTHS), F.lit(0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_words and log_perplexity (null without words) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(batch):
            logs, n = m.perplexity(batch.column(2))
            return {"doc_id": batch.column(0), "lang": batch.column(1), "n_words": n, "log_perplexity": pa.array(logs, mask=n == 0)}

        return f

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "lang", "text"), make, f"doc_id {kind}, lang string, n_words bigint, log_perplexity double")


def score_by_joins(docs: DataFrame, vocabulary: np.ndarray, tables: dict[str, DataFrame], floor: float) -> DataFrame:
    """As score, by joins: each distinct n-gram of the corpus meets the sharded counts once, then each document's n-grams its probability."""
    docs = stored(docs.select("doc_id", "lang", "text").withColumn("row", F.monotonically_increasing_id()), "rows")

    def make():
        def f(batch):
            w = Words(batch.column(1))
            _, columns = grams_of(w, vocabulary)
            row = batch.column(0).to_numpy()[w.doc()]
            _, at, c = np.unique(np.stack([row, columns["key"]]), axis=1, return_index=True, return_counts=True)
            return {k: v[at] for k, v in columns.items()} | {"row": row[at], "c": c}

        return f

    seen = stored(arrow_map(docs.select("row", "text"), make, GRAM + ", row bigint, c bigint"), "document-grams")
    p = seen.select("key", "ctx2", "key2", "ctx1", "word").dropDuplicates(["key"])
    for name, key, default in (("uni", "word", floor), ("own2", "key2", 0.0), ("ctx1", "ctx1", 1.0), ("own3", "key", 0.0), ("ctx2", "ctx2", 1.0)):
        p = p.join(tables[name].select(F.col("key").alias(key), F.col("value").alias(f"_{name}")), key, "left").fillna({f"_{name}": default})
    logs = F.log(F.greatest(F.lit(1e-12), F.col("_own3") + F.col("_ctx2") * (F.col("_own2") + F.col("_ctx1") * F.col("_uni"))).cast("double"))
    sums = seen.select("key", "row", "c").join(p.select("key", logs.alias("logs")), "key").groupBy("row").agg(F.sum("c").alias("n"), (-F.sum(F.col("c") * F.col("logs")) / F.sum("c")).alias("log_perplexity"))
    return docs.join(sums, "row", "left").select("doc_id", "lang", F.coalesce("n", F.lit(0).cast("long")).alias("n_words"), "log_perplexity")


def thresholds(scores: DataFrame, quantile: float, support: int) -> list[Row]:
    """lang, class, all_langs, all_classes, total, threshold of scores with lang, n_words, log_perplexity: one row for each language and class, and for all of either."""
    bins = scores.where("log_perplexity is not null").select("lang", length_class(F.col("n_words")).alias("class"), F.ceil(F.col("log_perplexity") * BIN).alias("bin"))
    bins = bins.groupBy("lang", "class", "bin").count().groupingSets([["lang", "class", "bin"], ["class", "bin"], ["lang", "bin"], ["bin"]], "lang", "class", "bin")
    bins = bins.agg(F.sum("count").alias("count"), F.grouping("lang").alias("all_langs"), F.grouping("class").alias("all_classes"))
    group = ["lang", "class", "all_langs", "all_classes"]
    ordered = bins.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("bin", "count"))).alias("bins"), F.sum("count").alias("total"))
    below = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin")), lambda acc, b: F.struct((acc["seen"] + b["count"]).alias("seen"), F.when(acc["seen"] < F.ceil(F.col("total") * quantile), b["bin"]).otherwise(acc["bin"]).alias("bin")))
    rows = ordered.select(*group, "total", (below["bin"] / BIN).alias("threshold"))
    return rows.where((F.col("total") >= support) | (F.col("all_langs") + F.col("all_classes") == 2)).collect()  # a few for each language


def limit_of(rows: list[Row], lang: Column, n_words: Column) -> Column:
    """The threshold that holds for a document."""
    out = F.lit(next((r.threshold for r in rows if r.all_langs and r.all_classes), float("inf")))
    of_class = length_class(n_words)
    for narrow in (lambda r: not r.all_langs and r.all_classes, lambda r: r.all_langs and not r.all_classes, lambda r: not r.all_langs and not r.all_classes):
        for r in filter(narrow, rows):
            fits = F.lit(True) if r.all_langs else lang.eqNullSafe(F.lit(r.lang))
            out = F.when(fits if r.all_classes else fits & (of_class == r["class"]), F.lit(r.threshold)).otherwise(out)
    return out


def held_out(scores: DataFrame, labels: DataFrame, sample: DataFrame) -> DataFrame:
    return scores.join(maybe_broadcast(trusted(labels).join(maybe_broadcast(sample), "doc_id", "left_anti")), "doc_id", "left_semi")


def judged(docs: DataFrame, labels: DataFrame, max_train: int | None, quantile: float, support: int, carried: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The carried columns, n_words, log_perplexity, threshold, kept of every document."""
    texts, sample = training_texts(docs, labels, max_train)
    scores = stored(score_by_shards(docs, train_shards(texts), carried), "scores")
    limit = limit_of(thresholds(held_out(scores, labels, sample), quantile, support), F.col("lang"), F.col("n_words"))
    return scores.withColumn("threshold", limit).withColumn("kept", F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(False)))


def classify(docs: DataFrame, labels: DataFrame, max_train: int | None = None, quantile: float = 0.999, support: int = 30) -> DataFrame:
    """doc_id, lang, n_words, log_perplexity, threshold, kept of every document."""
    return judged(docs, labels, max_train, quantile, support)


def filter_rows(docs: DataFrame, labels: DataFrame, max_train: int | None = None, quantile: float = 0.999, support: int = 30) -> DataFrame:
    """The kept rows of docs, all columns as they are. Rows go by id, language and text together, which settle the verdict."""
    fp = f"_fp_{uuid.uuid4().hex}"
    docs_ = docs.withColumn(fp, digest(F.col("text")))
    rows = judged(docs_, labels, max_train, quantile, support, ("doc_id", "lang", fp))
    gone = maybe_broadcast(stored(rows.where("not kept").select("doc_id", "lang", fp).distinct(), "rejected").toDF("of_id", "of_lang", "of_fp"))
    on = docs_["doc_id"].eqNullSafe(gone["of_id"]) & docs_["lang"].eqNullSafe(gone["of_lang"]) & (docs_[fp] == gone["of_fp"])
    return docs_.join(gone, on, "left_anti").select(*docs.columns)


def op9_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality_lm": op9_quality_lm}
SQL: dict[str, str] = {}
