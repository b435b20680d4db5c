"""Operator 5, benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit distance.

Words are compared without case and punctuation. A document leaks an item of n words if some stretch of it is within
floor(`edits` * n) word edits (insertions, deletions, substitutions) of the item. The steps, for a block of items and a batch
of documents:

1. Windows. An item with at most e edits leaves a run of at least floor((n - e) / (e + 1)) words as it was, so a window can
   only match if it shares such a run; runs of up to three words are looked up, and each hit gives the item-sized window that
   is aligned with it. This loses nothing and spares the embedding of clean text.
2. CGK random walk. Window and item are embedded into 3n steps: at each step the current word is written and the walk goes on
   to the next word or stays, by a random bit of step and word. Few edits leave few differing steps.
3. Bit-sampling LSH. Each repetition has a walk of its own and compares SAMPLES random steps; a window is a candidate if any
   repetition agrees. The number of repetitions is calibrated on the items themselves, with the full number of random edits,
   to reach `recall`.
4. Exact verification by bit-parallel edit distance with free ends, over the words themselves and not their hashes.

Items are a stated query set: they are handled in blocks of at most `block` items and BLOCK_BYTES of text, which are broadcast,
against all documents. Repetitions are calibrated once for a block, on the driver. No document is shuffled.

Result of search(): one row for each leaking document row and item: doc_id, item_id, edits, start, stop (words of the best
stretch), n_words of the item. Defined results: null texts count as empty; a document or item without a word leaks nothing; a
null id is reported as any other; repeated rows each give rows, and so do repeated items; empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from foliant.llm.common import arrow_map, table
from foliant.llm.hashing import PUNCT, U, Words, chain

SAMPLES = 2
#: Longest run that is looked up.
RUN = 3
#: Bytes of items that are broadcast at a time; one longer item is a block of its own.
BLOCK_BYTES = 16_000_000
#: Bytes of text that a worker searches at a time.
PART = 2_000_000
_TABLE = 20


def allowed(n: int, edits: float) -> int:
    return int(edits * n + 1e-9)


def folded(column) -> Words:
    """Words in lower case, parted by anything in ASCII but letters and digits."""
    return Words(pc.utf8_lower(column.cast(pa.large_string())), PUNCT)


def spelt(raw: bytes, w: Words, low: int, high: int) -> list[bytes]:
    """The words low to high themselves; raw is w's data."""
    return [raw[a:b] for a, b in zip(w.start[low:high].tolist(), w.end[low:high].tolist(), strict=True)]


class Walk:
    """CGK walks for strings of n words: random bits by step, and the steps that each repetition compares."""

    def __init__(self, n: int, repetitions: int):
        r = np.random.default_rng(n)
        self.n, self.steps = n, 3 * n
        self.odd = r.integers(0, 1 << 63, (self.steps, repetitions), dtype=U) * U(2) + U(1)
        self.at = r.integers(0, self.steps, (SAMPLES, repetitions))

    def __call__(self, words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """(windows, repetitions) hashes of the compared steps; a window is words[start:start + n], cut at stop."""
        place = np.zeros((len(start), self.odd.shape[1]), np.int64)
        end = np.minimum(stop - start, self.n)[:, None]
        picked = np.zeros((SAMPLES, *place.shape), U)
        for j in range(self.steps):
            symbol = np.where(place < end, words[np.minimum(start[:, None] + place, len(words) - 1)], U(0))
            for s in range(SAMPLES):
                which = self.at[s] == j
                if which.any():
                    picked[s][:, which] = symbol[:, which]
            place += ((symbol * self.odd[j]) >> U(63)).astype(np.int64)
        return chain(list(picked))


def edited(words: np.ndarray, e: int, r: np.random.Generator) -> np.ndarray:
    out = list(words)
    for _ in range(e):
        at, kind = int(r.integers(0, max(len(out), 1))), int(r.integers(0, 3))
        if kind == 0 and len(out) > 1:
            del out[at]
        elif kind == 1:
            out.insert(at, U(r.integers(1, 1 << 62)))
        else:
            out[at] = U(r.integers(1, 1 << 62))
    return np.array(out, U)


def repetitions(items: list[np.ndarray], edits: float, recall: float, most: int = 64, trials: int = 48) -> int:
    """Fewest repetitions that reach the recall on items with the full number of random edits."""
    r = np.random.default_rng(5)
    long = [x for x in items if allowed(len(x), edits)]
    if not long:
        return 4
    missed = []
    for k in range(trials):
        x = long[k * len(long) // trials % len(long)]
        y = edited(x, allowed(len(x), edits), r)
        walk = Walk(len(x), most)
        a = walk(x, np.zeros(1, np.int64), np.full(1, len(x)))
        b = walk(np.append(y, U(0)), np.zeros(1, np.int64), np.full(1, len(y)))
        missed.append(1.0 - (a == b).mean())
    missed = np.array(missed)
    for n in range(4, most):
        if (missed**n).mean() <= 1 - recall:
            return n
    return most


def distance(masks: dict, n: int, words) -> tuple[int, int]:
    """Least edit distance of the pattern of n words to any stretch of words, and the first stretch end that has it (Myers)."""
    full, high = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for k, c in enumerate(words, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, k
    return best, end


def bit_masks(words) -> dict:
    out: dict = {}
    for k, c in enumerate(words):
        out[c] = out.get(c, 0) | 1 << k
    return out


class Matcher:
    """Finds a block of items in batches of texts; calibrates the repetitions unless they are given."""

    def __init__(self, items: list[tuple], edits: float = 0.2, recall: float = 0.99, times: int | None = None):
        w = folded(pa.array([t for _, t in items], pa.string()))
        self.ids, raw = [i for i, _ in items], w.data.tobytes()
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.spelt = [spelt(raw, w, a, b) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.most = [allowed(len(x), edits) for x in self.words]
        self.repetitions = times or repetitions(self.words, edits, recall)
        self.seeds = {}
        by_run: dict[int, list] = {}
        for k, (x, e) in enumerate(zip(self.words, self.most, strict=True)):
            if len(x):
                run = max(1, min(RUN, (len(x) - e) // (e + 1)))
                g = chain([x[j : len(x) - run + 1 + j] for j in range(run)])
                by_run.setdefault(run, []).append((g, np.full(len(g), k), np.arange(len(g))))
        for run, parts in by_run.items():
            g, item, at = (np.concatenate([p[j] for p in parts]) for j in range(3))
            order = np.argsort(g, kind="stable")
            flags = np.zeros(1 << _TABLE, bool)
            flags[g >> U(64 - _TABLE)] = True
            self.seeds[run] = (flags, g[order], item[order], at[order])
        self.lengths = np.array([len(x) for x in self.words], np.int64)
        self._walks: dict[int, tuple] = {}

    def windows(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first word) of the item-sized windows that share a run with their item."""
        docs, found = w.doc(), []
        for run, (flags, seeds, item, at) in self.seeds.items():
            g, p = w.grams(run)
            near = np.flatnonzero(flags[g >> U(64 - _TABLE)])
            g, p = g[near], p[near]
            low, high = np.searchsorted(seeds, g, "left"), np.searchsorted(seeds, g, "right")
            times = high - low
            which = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            p = np.repeat(p, times)
            found.append(np.stack([docs[p], item[which], np.maximum(p - at[which], w.first[docs[p]])]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))

    def _walk(self, n: int):
        """The walk for n words, and the hashes of the items of that length by item."""
        if n not in self._walks:
            walk = Walk(n, self.repetitions)
            which = np.flatnonzero(self.lengths == n)
            flat = np.concatenate([self.words[k] for k in which])
            start = np.arange(len(which)) * n
            self._walks[n] = walk, dict(zip(which.tolist(), walk(flat, start, start + n), strict=True))
        return self._walks[n]

    def __call__(self, column) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, stop), the best stretch for each text and item."""
        w = folded(column)
        doc, item, start = self.windows(w)
        raw = w.data.tobytes() if len(doc) else b""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        length = self.lengths[item]
        for n in np.unique(length):
            group = np.flatnonzero(length == n)
            walk, known = self._walk(int(n))
            for part in np.array_split(group, -(-len(group) * self.repetitions // 200_000)):
                mine = walk(w.hash, start[part], w.first[doc[part] + 1])
                theirs = np.stack([known[k] for k in item[part].tolist()])
                for c in part[(mine == theirs).any(axis=1)].tolist():
                    self._verify(raw, w, int(doc[c]), int(item[c]), int(start[c]), best)
        return sorted((d, k, *v) for (d, k), v in best.items())

    def _verify(self, raw: bytes, w: Words, d: int, k: int, start: int, best: dict) -> None:
        pattern, most = self.spelt[k], self.most[k]
        low, high = max(int(w.first[d]), start - most), min(int(w.first[d + 1]), start + len(pattern) + 2 * most)
        stretch = spelt(raw, w, low, high)
        if most == 0:
            ok = stretch[: len(pattern)] == pattern
            cost, begin, end = (0 if ok else 1), 0, len(pattern)
        else:
            cost, end = distance(bit_masks(pattern), len(pattern), stretch)
            if cost <= most:
                begin = end - distance(bit_masks(pattern[::-1]), len(pattern), stretch[:end][::-1])[1]
        if cost <= most:
            new = (cost, low + begin - int(w.first[d]), low + end - int(w.first[d]))
            best[d, k] = min(best.get((d, k), new), new)


def blocks(items: DataFrame, block: int):
    """The items in lists of at most `block` and BLOCK_BYTES, read from Spark one partition at a time."""
    part, held = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        size = len((row.text or "").encode())
        if part and (len(part) == block or held + size > BLOCK_BYTES):
            yield part
            part, held = [], 0
        part.append((row.item_id, row.text))
        held += size
    if part:
        yield part


def search(docs: DataFrame, items: DataFrame, edits: float = 0.2, recall: float = 0.99, block: int = 20_000) -> DataFrame:
    """One row for each leaking document row and item."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    ids = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}"
    ddl = ids + ", edits int, start bigint, stop bigint, n_words int"
    out = spark.createDataFrame([], ddl)
    for part in blocks(items, block):
        shared = spark.sparkContext.broadcast((part, Matcher(part, edits, recall).repetitions))

        def make(shared=shared):
            m = Matcher(shared.value[0], edits, recall, shared.value[1])

            def f(batch):
                hits = m(batch.column(1))
                if not hits:
                    return None
                d, k, cost, start, stop = zip(*hits, strict=True)
                return {"doc_id": batch.column(0).take(pa.array(d)), "item_id": [m.ids[x] for x in k], "edits": cost, "start": start, "stop": stop, "n_words": [len(m.words[x]) for x in k]}

            return f

        out = out.unionByName(arrow_map(docs, make, ddl, limit=PART))
    return out


def filter_rows(docs: DataFrame, items: DataFrame, edits: float = 0.2, recall: float = 0.99, block: int = 20_000) -> DataFrame:
    """The rows of docs that leak no item, all columns as they are."""
    spark, text = docs.sparkSession, docs.columns.index("text")
    ddl = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema.fields)
    for part in blocks(items, block):
        shared = spark.sparkContext.broadcast((part, Matcher(part, edits, recall).repetitions))

        def make(shared=shared):
            m = Matcher(shared.value[0], edits, recall, shared.value[1])

            def f(batch):
                clean = np.ones(batch.num_rows, bool)
                clean[[h[0] for h in m(batch.column(text))]] = False
                held = np.flatnonzero(clean)
                return {c: batch.column(k).take(pa.array(held)) for k, c in enumerate(batch.schema.names)} if len(held) else None

            return f

        docs = arrow_map(docs, make, ddl, limit=PART)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontamination": op5_decontamination}
SQL: dict[str, str] = {}
