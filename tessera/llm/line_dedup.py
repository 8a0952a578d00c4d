"""Line dedup over a corpus: frequent lines keep only their last document.

Texts are split once, into a table of line hashes. The hashes are counted with map-side combining, and the occurrences of
frequent ones are range-partitioned by (hash, document descending), sorted by position within and streamed: the first
document of a hash keeps its lines, all later ones lose theirs. A hash that stands in a third of all documents spreads
over many tasks; a task that begins in the middle of one cannot know, so it marks that hash's first document, and two rows
from each task decide about the marks. What comes back is a compressed keep bitmap for each document, never text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_map, code_points, doc_frame, per_row, same, written


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(SPACES).lower() for line in text.split(b"\n")]


def _occurrences(min_chars: int):
    def of(doc_id, text, digest):
        keys = line_keys(text)
        at: dict[bytes, list[int]] = {}
        for i, key in enumerate(keys):
            if len(key) >= min_chars and code_points(key) >= min_chars:
                at.setdefault(key, []).append(i)
        return [(xxhash.xxh3_128_digest(k), doc_id, digest, len(keys), v) for k, v in at.items()]

    return of


#: Of an occurrence: it is dropped; it leads its task, and is dropped if an earlier task ends with its key; a task's end.
DROPPED, LEADING, ENDING = 0, 1, 2
STREAMED = "kind int, task int, key binary, doc_id long, digest long, n_lines int, lines array<int>"


def _streamed(batches):
    """Rows sorted by (key, document descending, position) in tasks of that order: all but a key's first document.

    A key may begin in an earlier task, so the first document of a task's first key only leads. The task's last key is
    told for the next one. Rows of one document stand together, even if it is there more than once.
    """
    task = TaskContext.get().partitionId()
    key, first, led = None, None, None
    for batch in batches:
        out = []
        for k, d, g, n, lines in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "digest", "n_lines", "lines"))):
            if k != key:
                led = k if key is None else led
                key, first = k, d
            if d != first:
                out.append((DROPPED, task, None, d, g, n, lines))
            elif k == led:
                out.append((LEADING, task, k, d, g, n, lines))
        yield out
    if key is not None:
        yield [(ENDING, task, key, None, None, None, None)]


def _bitmap(doc_id, digest, n_lines, dropped):
    keep = np.ones(n_lines, bool)
    for lines in dropped:
        keep[lines] = False
    return doc_id, digest, n_lines, int(n_lines - keep.sum()), zlib.compress(np.packbits(keep).tobytes())


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, digest, n_lines, n_dropped, bitmap) for each document that loses a line.

    A line's key is the line without ASCII white space at its ends, with A-Z lower-cased. Keys of ``min_chars`` code
    points or more that stand in ``min_docs`` rows or more keep only the lines in the row of the largest id. Null texts
    count as empty. Each row counts as a document; rows that tie for the largest id all keep, and a null id is below
    every other. Rows with equal id and text share one bitmap. ``digest`` is a hash of the text, so that repeated ids
    with different texts are told apart. An empty table gives an empty result.
    """
    rows = doc_frame(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))
    seen = written(per_row(rows, _occurrences(min_chars), "key binary, doc_id long, digest long, n_lines int, lines array<int>", many=True), "lines")
    frequent = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("key")
    hits = seen.join(written(frequent, "frequent"), "key")  # from a table, so that the join deals both sides out itself and can split a hot key
    dealt = hits.repartitionByRange("key", F.col("doc_id").desc_nulls_last()).sortWithinPartitions("key", F.col("doc_id").desc_nulls_last(), F.col("lines")[0])
    streamed = written(arrow_map(dealt, _streamed, STREAMED), "streamed")
    # Ends are sorted like the tasks: a key began earlier where a task before this one ends with it. A row for each task.
    ends = streamed.where(f"kind = {ENDING}").groupBy(F.col("key").alias("of")).agg(F.min("task").alias("since"))
    leading = streamed.where(f"kind = {LEADING}")
    late = leading.join(ends, (leading["key"] == ends["of"]) & (ends["since"] < leading["task"]), "left_semi")
    dropped = streamed.where(f"kind = {DROPPED}").union(late).select("doc_id", "digest", "n_lines", "lines")
    whole = dropped.groupBy("doc_id", "digest").agg(F.first("n_lines").alias("n_lines"), F.collect_list("lines").alias("lines"))
    return per_row(whole, _bitmap, "doc_id long, digest long, n_lines int, n_dropped int, bitmap binary")


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """(lines before, lines dropped, remaining text)."""
    lines = text.split(b"\n")
    if bitmap is None:
        return len(lines), 0, text
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines)).astype(bool)
    left = [x for x, k in zip(lines, keep) if k]
    return len(lines), len(lines) - len(left), b"\n".join(left)


def _dealt(maps: DataFrame) -> DataFrame:
    """Bitmaps meet texts by a join that deals both out, as few bitmaps as many: the plan is the same at every size."""
    return maps.hint("merge")


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Every row as (doc_id, text, bitmap); bitmap is null where nothing is dropped."""
    rows = doc_frame(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))
    maps = line_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    return rows.join(_dealt(maps), same(rows, maps, "doc_id", "digest"), "left").select(rows["doc_id"], rows["text"], maps["bitmap"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with all its columns, its texts without the dropped lines.

    A text that loses all its lines becomes empty; a null text stays null. Column names may be anything.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    plain = plain.withColumn("_doc", F.col(key).cast("long")).withColumn("_digest", F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))
    maps = line_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    joined = plain.join(_dealt(maps), plain["_doc"].eqNullSafe(maps["doc_id"]) & plain["_digest"].eqNullSafe(maps["digest"]), "left")

    @F.pandas_udf("string")
    def left_over(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
        return pd.Series([t if b is None or t is None else kept_lines(t.encode(), b)[2].decode() for t, b in zip(texts, bitmaps)], dtype=object)

    out = [left_over(F.col(text), F.col("bitmap")) if c == text else F.col(c) for c in plain.columns[: len(names)]]
    return joined.select(*[c.alias(n) for c, n in zip(out, names)])
