"""Operator 3, near duplicates: ProbMinHash signatures, banding, exact verification, connected classes.

A document is the weighted set of its windows of five words (all its words, if fewer), a window seen c times weighing
1 + ln(c). Each window is a Poisson process whose rate is its weight; every arrival falls into a random one of PLACES
signature places, and a place keeps the window that arrives first. A window stops as soon as its next arrival is later than
the last place's first one (early termination), so two signatures agree in a place with the probability Jaccard similarity
of the sets. A document that repeats windows has a second signature in which each weighs 1, for plain Jaccard similarity; in
any other document both are the same. Documents that agree in all places of a band, of either signature, meet in a bucket;
the bands follow from the threshold (`layout`), so that a pair at the threshold is missed with probability 3e-5. Of those that
meet, pairs that agree in too few of all places, compared by BITS bits of each, in both kinds of signature, are no candidates;
the bound loses one pair in 100,000 at the threshold. Candidates are verified exactly, on the bytes of their words and not on
hashes: linked if the probability Jaccard similarity or the plain one of the sets of windows reaches `threshold`.

Scale: exact copies are collapsed first, with partial aggregation, so a group of copies costs one candidate. In a bucket
each member is compared with the bucket's least text alone, which joins any number of near copies in linear time; classes are
then formed, and only buckets that still hold several classes are compared further, with 16, 256, ... pivots in turn until
every pair of different classes in them has been tested, in the first bucket that it shares. Pivots come in the order of the
hash of a text's number, hence a group that meets in many buckets has the same pivots in all; they are chosen in SALTS parts
of a bucket before the bucket as a whole, so that no task orders a large bucket. Text is read again only for candidates, and a
text that many are compared with is joined last, where Spark splits it. All intermediate tables are written to the shared
folder; nothing of the corpus reaches the driver but counts.

Result: one row for each document: doc_id, class_id (least id of its class), kept (whether it is the document of its class
that stays: of the least id, and of the least digest where that id has several texts).
Defined results: classes are of texts, so an id that comes with several texts can be in several classes; a text that is null
or has no word is alone in its class and kept; ids that are null come last, and a class without any id has a null class_id;
rows that repeat both id and text have the same result each, and filter_rows keeps one of them; an empty table gives no rows;
columns other than id and text are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import arrow_map, digest, maybe_broadcast, stored, table
from foliant.llm.hashing import U, Words, chain, exact_windows, mix

SHINGLE = 5
#: Places of a signature; a multiple of 64.
PLACES = 384
#: Bits of each place that are compared.
BITS = 4
#: Times as many pivots in each further round.
GROWTH = 16
#: Parts of a bucket that are ordered apart.
SALTS = 16
#: Bytes of text that a worker sketches at a time, and half as many of either side of the pairs that it verifies.
HELD = 300_000


def layout(threshold: float, loss: float = 3e-5, most: int = 20) -> tuple[int, int]:
    """(bands, places of each): the longest bands of which `most` lose no more than a share `loss` of the pairs at the threshold."""
    bands_of = lambda rows: math.ceil(math.log(loss) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
    rows = max((r for r in range(1, 17) if bands_of(r) <= most), default=1)
    return bands_of(rows), rows


def shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, times) of the distinct windows of k words, by text and hash; a shorter text is one window."""
    doc = w.doc()
    n = np.diff(w.first)
    hashes, docs = [], []
    g, at = w.grams(k)
    hashes.append(g)
    docs.append(doc[at])
    for short in range(1, k):
        which = np.flatnonzero(n == short)
        if len(which):
            hashes.append(chain([w.hash[w.first[which] + j] for j in range(short)]))
            docs.append(which)
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(h)))


def _uniform(e: np.ndarray, salt: int) -> np.ndarray:
    return ((mix(e ^ mix(np.array([salt], U))) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, places: int) -> np.ndarray:
    """n_docs x places: the window that arrives first in each place."""
    first = np.full(n_docs * places, np.inf)
    sign = np.zeros(n_docs * places, U)
    e, d, w = mix(shingle), doc, weight
    t = -np.log(_uniform(e, 0)) / w
    turn = 0
    while len(e):
        at = d * places + (mix(e ^ mix(np.array([2 * turn + 1], U))) % U(places)).astype(np.int64)
        np.minimum.at(first, at, t)
        won = first[at] == t
        sign[at[won]] = e[won]
        last = first.reshape(n_docs, places).max(axis=1)
        turn += 1
        t = t - np.log(_uniform(e, 2 * turn)) / w
        on = t < last[d]
        e, d, w, t = e[on], d[on], w[on], t[on]
    return sign.reshape(n_docs, places)


def sketch(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, fp (digest of the text), bands (null without words) and BITS bits of each place, by 64, of every row.

    Where windows repeat, both arrays go on with those of the plain signature; bands that are the same are null in it."""

    def make():
        def keyed(sign):
            keys = np.stack([chain([np.full(len(sign), b, U), *(sign[:, b * rows + r] for r in range(rows))]) for b in range(bands)], axis=1).view(np.int64)
            return keys, np.stack([np.packbits(((sign >> U(k)) & U(1)).astype(np.uint8), axis=1).view(np.int64) for k in range(BITS)], axis=1).reshape(len(sign), -1)

        def f(batch):
            w = Words(batch.column(2))
            d, h, times = shingles(w)
            keys, bits = keyed(signatures(d, h, 1.0 + np.log(times), batch.num_rows, PLACES))
            some = np.diff(w.first) > 0
            bands_, bits_ = [k if s else None for k, s in zip(keys.tolist(), some, strict=True)], list(bits)
            repeats = np.bincount(d[times > 1], minlength=batch.num_rows) > 0
            if repeats.any():
                on = repeats[d]
                plain = keyed(signatures((np.cumsum(repeats) - 1)[d[on]], h[on], np.ones(on.sum()), int(repeats.sum()), PLACES))
                for r, key, bit in zip(np.flatnonzero(repeats).tolist(), *plain, strict=True):
                    bands_[r] = bands_[r] + [k if k != was else None for k, was in zip(key.tolist(), bands_[r], strict=True)]
                    bits_[r] = np.concatenate([bits_[r], bit])
            return {"doc_id": batch.column(0), "fp": batch.column(1), "bands": bands_, "bits": bits_}

        return f

    docs = docs.select("doc_id", digest(F.col("text")).alias("fp"), "text")
    return arrow_map(docs, make, "doc_id bigint, fp binary, bands array<bigint>, bits array<bigint>", limit=HELD)


def similarity(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Plain and probability Jaccard similarity of the texts of each row, exactly."""
    rows = len(a)
    d, g = exact_windows(Words(pa.concat_arrays([x.cast(pa.large_string()) for x in (a, b)])), SHINGLE)
    order = np.lexsort((d, g, d % rows))
    d, g = d[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    weight = 1 + np.log(np.diff(np.append(at, len(g))))
    d, g = d[at], g[at]
    wa, wb, d = np.where(d < rows, weight, 0.0), np.where(d < rows, 0.0, weight), d % rows
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    wa, wb, d = (np.add.reduceat(wa, at), np.add.reduceat(wb, at), d[at]) if len(at) else (wa, wb, d)
    shared = (wa > 0) & (wb > 0)
    union, both = np.bincount(d, minlength=rows), np.bincount(d[shared], minlength=rows)
    plain = both / np.maximum(union, 1)
    probability = plain.copy()
    many = np.bincount(d[(wa > 1) | (wb > 1)], minlength=rows) > 0
    ends = np.searchsorted(d, np.arange(rows + 1))
    for r in np.flatnonzero(many & (both > 0)):  # where weights differ
        va, vb = wa[ends[r] : ends[r + 1]], wb[ends[r] : ends[r + 1]]
        with np.errstate(divide="ignore"):
            by = np.argsort(va / vb, kind="stable")
        va, vb = va[by], vb[by]
        above, below = np.cumsum(va[::-1])[::-1], np.cumsum(vb) - vb
        s = (va > 0) & (vb > 0)
        probability[r] = (1.0 / (above[s] / va[s] + below[s] / vb[s])).sum()
    return plain, probability


def least_agreement(threshold: float, loss: float = 1e-5) -> int:
    """Places in which two signatures of the threshold's similarity agree, by their bits, but for a share `loss` of the pairs."""
    p, total = threshold + (1 - threshold) / 2**BITS, 0.0
    term = (1 - p) ** PLACES
    for k in range(PLACES):
        total += term
        if total > loss:
            return k
        term *= (PLACES - k) / (k + 1) * p / (1 - p)
    return PLACES


def part(x: Column, k: int, plain: int = 0) -> Column:
    """Item k of the bands or bits; with their number as `plain`, that of the plain signature."""
    return F.coalesce(F.get(x, F.lit(plain + k)), F.get(x, F.lit(k))) if plain else F.get(x, F.lit(k))


def agreeing(a: Column, b: Column, plain: int = 0) -> Column:
    """Number of places that agree in all bits."""
    n = PLACES // 64
    xor = lambda k: part(a, k, plain).bitwiseXOR(part(b, k, plain))
    differ = [F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), [xor(j * n + k) for j in range(BITS)])) for k in range(n)]
    return F.lit(PLACES) - sum(differ[1:], differ[0])


def alike(a: Column, b: Column, least: int) -> Column:
    """Whether the signatures of either kind agree in so many places."""
    return (agreeing(a, b) >= least) | (agreeing(a, b, BITS * PLACES // 64) >= least)


def verified(pairs: DataFrame, docs: DataFrame, key: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts reach the threshold; key has node, fp and rep, an id that has the text.

    a is joined last: where it stands in many pairs its text is never shuffled with them."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = key.join(maybe_broadcast(ids), "node", "left_semi").withColumnRenamed("fp", "of")
    found = docs.join(maybe_broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("rep")) & (digest(F.col("text")) == F.col("of")))
    texts = stored(found.groupBy("node").agg(F.min("text").alias("text")), "candidate-texts")  # rows may repeat
    both = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")

    def make():
        def f(batch):
            plain, probability = similarity(batch.column(2), batch.column(3))
            linked = np.flatnonzero(np.maximum(plain, probability) >= threshold - 1e-12)
            return {"a": batch.column(0).take(pa.array(linked)), "b": batch.column(1).take(pa.array(linked))}

        return f

    return arrow_map(both.select("a", "b", "text_a", "text_b"), make, "a bigint, b bigint", "text_a", HELD // 2).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (least node of its component): least labels spread along edges, and each label is replaced by its own label."""
    e = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    now = stored(e.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), F.least("a", "label").alias("label")), "labels")
    while True:
        near = e.join(now.toDF("b", "of"), "b").groupBy("a").agg(F.min("of").alias("of")).withColumnRenamed("a", "node")
        step = stored(now.join(near, "node").select("node", F.least("label", "of").alias("label"), F.col("label").alias("was")), "labels")
        jumped = step.join(step.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        new = stored(jumped.select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "was"), "labels")
        if new.where("label != was").isEmpty():
            return new.select("node", "label")
        now = new.select("node", "label")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links: only what the links join is gone through again, as edges between classes."""
    of = lambda side: labels.toDF(side, f"class_{side}")
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")).where("a != b").distinct()
    to = components(between).toDF("label", "to")
    alone = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(labels, "node", "left_anti")
    return stored(labels.unionByName(alone.withColumn("label", F.col("node"))).join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def pivots_of(rows: DataFrame, after: int, upto: int) -> DataFrame:
    """The rows of ranks after + 1 to upto of each bucket by (h, id): first in SALTS parts of the bucket, then in it."""
    first = lambda *by: F.row_number().over(Window.partitionBy("bucket", *by).orderBy("h", "id"))
    part = rows.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).withColumn("rank", first("salt")).where(F.col("rank") <= upto)
    return part.drop("rank").withColumn("rank", first()).where(F.col("rank") <= upto).where(F.col("rank") > after)


def linked(one: DataFrame, docs: DataFrame, key: DataFrame, threshold: float, bands: int, pivots: int) -> DataFrame:
    """node and label (least node of its class) of the nodes that are linked; one has node, bands, bits."""
    least = least_agreement(threshold)
    entries = one.select(F.posexplode("bands").alias("at", "bucket"), F.col("node").alias("id")).where("bucket is not null")
    entries = entries.select((F.col("at") % bands).alias("band"), "bucket", "id")
    centres = stored(entries.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("far")).where("centre < far").select("bucket", "centre"), "centres")
    members = stored(entries.join(centres, "bucket"), "members")
    bits = one.select(F.col("node").alias("id"), "bits", "bands")
    pairs = members.where("id != centre").select("centre", "id").distinct()
    pairs = pairs.join(bits.select("id", "bits"), "id").join(bits.select(F.col("id").alias("centre"), F.col("bits").alias("bits_b")), "centre")
    pairs = stored(pairs.where(alike(F.col("bits"), F.col("bits_b"), least)).select(F.col("centre").alias("a"), F.col("id").alias("b")), "pairs")
    tested, labels, ranks = pairs, components(stored(verified(pairs, docs, key, threshold), "links")), 0
    while True:
        rows = members.join(labels.toDF("id", "label"), "id", "left").select("bucket", "band", "id", F.coalesce("label", "id").alias("label"))
        spread = rows.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("size")).where(f"least < most and size > {ranks}")
        spread = stored(spread.select("bucket"), "spread")
        if spread.isEmpty():
            return labels
        upto = ranks * GROWTH or pivots
        open_ = stored(rows.join(spread, "bucket").join(bits, "id").withColumn("h", F.xxhash64("id")), "open")
        p = pivots_of(open_, ranks, upto).select("bucket", F.col("h").alias("h_b"), F.col("id").alias("pivot"), F.col("label").alias("other"), F.col("bits").alias("bits_b"), F.col("bands").alias("bands_b"))
        # each pair once: in the first bucket that it shares by signatures of one kind, from the pivot that comes first
        shares = lambda k, plain: part(F.col("bands"), k, plain) == part(F.col("bands_b"), k, plain)
        later = (F.col("h") > F.col("h_b")) | ((F.col("h") == F.col("h_b")) & (F.col("id") > F.col("pivot")))
        new = reduce(lambda x, k: x & ~((F.col("band") > k) & (shares(k, 0) | shares(k, bands))), range(bands - 1), later & (F.col("label") != F.col("other")))
        more = open_.join(p, "bucket").where(new & alike(F.col("bits"), F.col("bits_b"), least)).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        more = stored(more.join(tested, ["a", "b"], "left_anti"), "pairs")
        ranks = upto
        if not more.isEmpty():
            tested = tested.unionByName(more)
            found = stored(verified(more, docs, key, threshold), "links")
            if not found.isEmpty():
                labels = merged(labels, found)


def classified(docs: DataFrame, threshold: float = 0.8, pivots: int = 16) -> DataFrame:
    """doc_id, fp, class_id, kept of every row; fp is null where the text has no word."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    bands, rows = layout(threshold)
    sketches = stored(sketch(docs, bands, rows), "sketches")
    # a text's node is numbered as it is written, so that it is one number for good and no two texts share it
    one = sketches.where("bands is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first(F.struct("bands", "bits")).alias("s"))
    one = stored(one.select(F.monotonically_increasing_id().alias("node"), "fp", "rep", "s.*"), "texts-once")
    key = one.select("node", "fp", "rep")
    labels = linked(one, docs, key, threshold, bands, pivots)
    first = F.min(F.struct(F.col("rep").isNull().alias("last"), "rep", "fp"))  # ids that are null come last
    heads = stored(key.join(labels, "node").groupBy("label").agg(first.alias("head")).select("label", "head"), "heads")
    of = key.join(labels.join(heads, "label").select("node", "head"), "node", "left")
    of = of.select("fp", F.coalesce("head.rep", F.when(F.col("head").isNull(), F.col("rep"))).alias("class_id"), F.coalesce("head.fp", "fp").alias("head_fp"))
    out = sketches.select("doc_id", F.when(F.col("bands").isNotNull(), F.col("fp")).alias("fp")).join(of, "fp", "left")
    kept = F.col("fp").isNull() | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("fp") == F.col("head_fp")))
    return out.select("doc_id", "fp", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), kept.alias("kept"))


def classes(docs: DataFrame, threshold: float = 0.8, pivots: int = 16) -> DataFrame:
    """doc_id, class_id, kept of every row."""
    return classified(docs, threshold, pivots).drop("fp")


def filter_rows(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that stay, all columns as they are: one row of each class, and every row without words.

    Rows go by id and text together, so that no class is lost where ids repeat."""
    found = stored(classified(docs, threshold).where("fp is not null"), "classes")
    key = docs.withColumns({"_id": F.col("doc_id").cast("bigint"), "_fp": digest(F.col("text"))})
    on = lambda df: F.col("_id").eqNullSafe(df["id"]) & (F.col("_fp") == df["fp"])
    rows = found.select(F.col("doc_id").alias("id"), "fp", "kept").groupBy("id", "fp").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    rows = stored(rows.where("not kept or n > 1"), "gone-or-repeated")
    gone, repeated = (maybe_broadcast(rows.where(c).select("id", "fp")) for c in ("not kept", "kept"))
    once = key.join(gone, on(gone), "left_anti")
    if rows.where("kept").isEmpty():
        return once.select(*docs.columns)
    # only rows that repeat id and text are dealt anew
    twice = once.join(repeated, on(repeated), "left_semi").dropDuplicates(["_id", "_fp"])
    return once.join(repeated, on(repeated), "left_anti").unionByName(twice).select(*docs.columns)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op3_near_dup": op3_near_dup}
SQL: dict[str, str] = {}
