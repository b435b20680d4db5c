"""Deterministic samples, splits and numbering by digest order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.hashing import sha_order

#: Quotas of each register in the draws (fixed values): mail for e-mail, pdf for reports, ticket for issues, chat for dialogues, code for source files, log for logs.
QUOTAS = {
    "first": {"mail": 760, "pdf": 560, "ticket": 340, "chat": 240, "code": 170, "log": 110},
    "more-": {"mail": 1100, "pdf": 1100, "chat": 500, "code": 300},
    "faith-": {"mail": 1200, "pdf": 1200, "ticket": 600, "chat": 500, "code": 300, "log": 200},
    "dpo-": {"mail": 450, "pdf": 450, "chat": 200, "code": 100},
}
BOOST_REGISTERS = ["mail", "pdf", "ticket"]
BOOST_TARGET = 300
BOOST_WINDOW = 6000
#: Words of five rare topics (fixed values).
RARE = (
    r"(?iU)\b(salary|salaries|compensation|equity|bonus|stock option|severance|"
    r"acquisition|acquire|merger|divestiture|due diligence|term sheet|"
    r"password|passwd|api[_ ]?key|secret key|access token|private key|credential|"
    r"ssn|social security|customer data|personal data|gdpr|hipaa|phi\b|pii\b|"
    r"audit|compliance|regulation|regulatory|sec filing|10-k|certification)\b"
)


def length_gate(text: Column, least: int = 200, most: int = 20_000) -> Column:
    """Code points within both bounds; null fails."""
    return F.coalesce(F.length(text).between(least, most), F.lit(False))


def quota_top(df: DataFrame, quotas: dict[str, int], prefix: str = "", source: str = "src", fp: str = "fp", tie: str = "i") -> DataFrame:
    """The first rows of each source in digest order; sources without a quota give none. Adds src_ord and rank."""
    order = F.create_map(*[F.lit(x) for k, s in enumerate(quotas) for x in (s, k)])
    limit = F.create_map(*[F.lit(x) for s, q in quotas.items() for x in (s, q)])
    w = Window.partitionBy(source).orderBy(sha_order(prefix, F.col(fp)), F.col(tie))
    largest = max(quotas.values(), default=0)
    out = df.where(F.col(source).isin(list(quotas))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= largest)
    return out.where(F.col("rank") <= F.try_element_at(limit, F.col(source))).withColumn("src_ord", F.try_element_at(order, F.col(source)))


def first_seen(df: DataFrame, *order, fp: str = "fp") -> DataFrame:
    """One row for each fingerprint, the first in the given order; run after the quota, so repeats shrink the sample."""
    by = F.struct(*[F.col(o).alias(f"o{k}") if isinstance(o, str) else o.alias(f"o{k}") for k, o in enumerate(order)])
    return df.groupBy(fp).agg(F.min_by(F.struct(*df.columns), by).alias("_first")).select("_first.*")


def base_and_boost(df: DataFrame, quotas: dict[str, int], pattern: str = RARE, registers=BOOST_REGISTERS, target: int = BOOST_TARGET, source: str = "src") -> DataFrame:
    """Base tier by quota, then a boost tier: unseen rows with a rare word, pooled over registers, first in digest order."""
    base = first_seen(quota_top(df, quotas, source=source), "src_ord", "rank").select(*df.columns).withColumn("tier", F.lit("base"))
    pool = df.where(F.col(source).isin(registers) & F.left("text", F.lit(BOOST_WINDOW)).rlike(pattern)).join(base.select("fp"), "fp", "left_anti").select(*df.columns)
    boost = pool.orderBy(sha_order(F.col("fp")), "i").limit(target)
    boost = first_seen(boost, F.col("i")).withColumn("tier", F.lit("boost"))
    return base.unionByName(boost)


def excluding(df: DataFrame, used: DataFrame, on: str = "id", used_fp: DataFrame | None = None) -> DataFrame:
    """Rows whose key isn't used; rows without a key stay, unless their fingerprint is given as used too."""
    out = df.join(used.select(on).where(F.col(on).isNotNull()).distinct(), on, "left_anti")
    return out if used_fp is None else out.join(used_fp.select("fp").distinct(), "fp", "left_anti")


def numbered(df: DataFrame, *order, start: int = 0) -> DataFrame:
    """Dense numbers from start in the given order, over a drawn (small) sample."""
    return df.withColumn("n", F.row_number().over(Window.orderBy(*order)) - 1 + start)


def next_id(df: DataFrame, column: str = "i") -> int:
    """One more than the greatest id; 0 for none."""
    return int(df.agg(F.coalesce(F.max(column) + 1, F.lit(0))).head()[0])


def second_draw(df: DataFrame, used: DataFrame, quotas: dict[str, int], prefix: str = "more-", source: str = "src", start: int = 0) -> DataFrame:
    """A later draw, source by source in the order of the quotas: rows whose id or fingerprint is an id used before are out, and so are
    fingerprints that an earlier source drew; repeats within a source stay. Adds n, numbers from start."""
    fresh = excluding(df, used.select("id"), "id", used.select(F.col("id").alias("fp")).where("fp is not null"))
    picked, seen = None, None
    for k, (s, quota) in enumerate(quotas.items()):  # one step for each of a few sources
        pool = fresh.where(F.col(source) == s)
        pool = pool if seen is None else pool.join(seen, "fp", "left_anti").select(*fresh.columns)
        drawn = quota_top(pool, {s: quota}, prefix, source).withColumn("src_ord", F.lit(k))
        picked = drawn if picked is None else picked.unionByName(drawn)
        seen = picked.select("fp").distinct()
    return numbered(picked, "src_ord", "rank", start=start)


def _cutoffs(df: DataFrame, limits: Column, most: int, source: str, key: str) -> DataFrame:
    """_source, _last: the digest and key of the row at each source's limit, or of its last row. Ranks beyond `most` are pruned before the shuffle."""
    digest = sha_order(F.col(key))
    w = Window.partitionBy(source).orderBy(digest, F.col(key))
    first = df.select(source, key).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).where(F.col("_r") <= limits)
    return first.groupBy(F.col(source).alias("_source")).agg(F.max(F.struct(digest.alias("h"), F.col(key).alias("k"))).alias("_last"))


def stratified_split(df: DataFrame, holdout: int = 35, source: str = "src", key: str = "i") -> DataFrame:
    """split: the first rows of each source in digest order are eval, the rest train."""
    last = F.broadcast(_cutoffs(df, F.lit(holdout), holdout, source, key))  # one row for each source
    inside = F.struct(sha_order(F.col(key)).alias("h"), F.col(key).alias("k")) <= F.col("_last")
    return df.join(last, F.col(source).eqNullSafe(F.col("_source")), "left").select(*df.columns, F.when(inside, "eval").otherwise("train").alias("split"))


def register_split(df: DataFrame, train_sources: list[str], in_dist: int = 35, out_cap: int = 100, source: str = "src", key: str = "i") -> DataFrame:
    """split: eval_id and train for the training registers; eval_ood, and drop beyond the cap, for the held-out ones."""
    known = F.coalesce(F.col(source).isin(train_sources), F.lit(False))
    last = F.broadcast(_cutoffs(df, F.when(known, in_dist).otherwise(out_cap), max(in_dist, out_cap), source, key))
    first = F.struct(sha_order(F.col(key)).alias("h"), F.col(key).alias("k")) <= F.col("_last")
    split = F.when(known & first, "eval_id").when(known, "train").when(first, "eval_ood").otherwise("drop")
    return df.join(last, F.col(source).eqNullSafe(F.col("_source")), "left").select(*df.columns, split.alias("split"))


def oversampled(df: DataFrame, when: Column, times: int) -> DataFrame:
    """Rows for which `when` holds, that many times in all."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(when, F.lit(times)).otherwise(1))))
