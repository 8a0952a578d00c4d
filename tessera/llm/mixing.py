"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training progress t in [0, 1]. Its integral is the source's cumulative token
demand; a document that stands at some offset of its source's shuffled stream is trained on when demand reaches that
offset, so inverting the integral gives its position. The stream's offsets are prefix sums in two levels, so that a
source which holds a third of all rows is summed by many tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import per_row, quoted, tune, written

#: Repeating base weights of the sources in code-point order, null last.
WEIGHTS = (5.0, 2.0, 1.0)
#: Repeating (start, end) multipliers of a source's weight; it changes linearly over training and averages 1.
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
MAX_REPEATS = 3
#: Rows of a source that one task sums.
ROWS_PER_BUCKET = 2048

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_count(text: bytes) -> int:
    return len(text.split())


def targets(sizes: dict, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> dict:
    """Each source's share of all sizes by weight, at most ``max_repeats`` times its size, the excess reshared."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: float(max_repeats * sizes[s]) for s in names}
    fixed: dict = {}
    left = float(sum(sizes.values()))
    while open_ := [s for s in names if s not in fixed]:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > cap[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = cap[s]
        left = float(sum(sizes.values())) - sum(fixed.values())
    return fixed


def _position(offset: Column) -> Column:
    """Training progress at which the source's demand T * (s t + (e - s) t^2 / 2) reaches ``offset``; s + e = 2."""
    a = (F.col("end") - F.col("start")) / 2
    u = offset / F.greatest(F.col("quota"), F.lit(1))
    root = F.sqrt(F.greatest(F.col("start") * F.col("start") + 4 * a * u, F.lit(0.0)))
    return 2 * u / (F.col("start") + root)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, schedules: Sequence[tuple[float, float]] = SCHEDULES, max_repeats: int = MAX_REPEATS, seed: int = 11) -> DataFrame:
    """(doc_id, digest, size, source, source_size, target, taken, takes, position, positions), sorted by position.

    size: words of the text, null 0. taken: words that the mix takes, repeats counted; of the last document that a
    source gives only the words up to its quota. takes: the words of each repeat, positions: when each is trained on.
    Documents that are not taken have an empty list and a null position. Within a source documents stand in the order of
    a seeded hash of id and text, so reruns agree; repeated rows are separate documents that tie, which leaves the same
    set of results. A null source is a source of its own, last in order; a null id is allowed. Empty sources get 0.
    One row for each source reaches the driver, whatever the number of documents: sources are few named collections, not
    domains, and their targets depend on each other.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col).cast("binary"), F.lit(b"")).alias("text"), quoted(source_col).cast("string").alias("source"))
    rows = rows.select("doc_id", "text", "source", F.xxhash64("text").alias("digest"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 1).alias("place"))  # 63 bits
    sized = written(per_row(rows, lambda d, t, s, g, p: (d, g, s, p, word_count(t)), "doc_id long, digest long, source string, place long, size long"), "sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    total = {r["source"]: r["size"] for r in found}
    target = targets(total, weights, max_repeats)
    names = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    plan = [(s, total[s], float(target[s]), int(round(target[s])), *map(float, schedules[i % len(schedules)])) for i, s in enumerate(names)]
    sources = spark.createDataFrame(plan, "name string, source_size long, target double, quota long, start double, end double")

    bits = max(0, math.ceil(math.log2(max(1, sum(r["n"] for r in found)) / ROWS_PER_BUCKET)))
    sized = sized.withColumn("bucket", F.shiftright("place", 63 - bits) if bits else F.lit(0).cast("long"))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(sums, placed["source"].eqNullSafe(sums["of"]) & (placed["bucket"] == sums["at"])).withColumn("offset", F.col("before") + F.col("inside"))
    placed = placed.join(sources, placed["source"].eqNullSafe(sources["name"]))
    starts = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda k: F.col("offset") + k * F.col("source_size"))
    takes = F.transform(starts, lambda o: F.struct(_position(o).alias("position"), F.least(F.greatest(F.col("quota") - o, F.lit(0)), F.col("size")).alias("words")))
    placed = placed.withColumn("all", F.filter(takes, lambda x: x["words"] > 0))
    out = placed.select(
        "doc_id", "digest", "size", "source", "source_size", "target",
        F.coalesce(F.aggregate("all", F.lit(0).cast("long"), lambda acc, x: acc + x["words"]), F.lit(0).cast("long")).alias("taken"),
        F.transform("all", lambda x: x["words"]).alias("takes"),
        F.when(F.size("all") > 0, F.element_at("all", 1)["position"]).alias("position"),
        F.transform("all", lambda x: x["position"]).alias("positions"),
    )
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id", "digest")


def first_words(text: bytes, n: int) -> bytes:
    """``text`` up to the end of its n-th word; all of it if it has no more words than that."""
    if n >= word_count(text):
        return text
    end = 0
    for _, word in zip(range(n), WORD.finditer(text)):
        end = word.end()
    return text[:end]


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with all its columns as the mix takes them: a row for each take, range-sorted by training position.

    Documents that the mix does not take go; a document taken k times comes k times; the last one of a source may be cut
    after the words that fill the quota. Repeated rows (equal id and text) are matched to their decisions one to one by
    rank, and a document without words has nothing to take.
    """
    decided = mix(docs, id_col, text_col, source_col, **options).where("taken > 0")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text, source = (f"c{names.index(c)}" for c in (id_col, text_col, source_col))
    plain = plain.withColumn("_digest", F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))).withColumn("_doc", F.col(key).cast("long")).withColumn("_source", F.col(source).cast("string"))
    # Equal id, text and source: any pairing of such rows gives the same set, so ranks pair them.
    plain = plain.withColumn("_rank", F.row_number().over(Window.partitionBy("_doc", "_digest", "_source").orderBy(*plain.columns[: len(names)])))
    decided = decided.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "digest", "source").orderBy("position")))
    on = plain["_doc"].eqNullSafe(decided["doc_id"]) & (plain["_digest"] == decided["digest"]) & plain["_source"].eqNullSafe(decided["source"]) & (plain["_rank"] == decided["rank"])
    each = plain.join(decided, on).withColumn("take", F.explode(F.arrays_zip("takes", "positions")))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, words: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([t if w >= n else first_words(t.encode(), w).decode() for t, w, n in zip(texts, words, sizes)], dtype=object)

    out = [cut(F.col(text), F.col("take.takes"), F.col("size")) if c == text else F.col(c) for c in plain.columns[: len(names)]]
    return each.orderBy("take.positions", "_doc").select(*[c.alias(n) for c, n in zip(out, names)])
