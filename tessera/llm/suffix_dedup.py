"""Removal of long repeated byte strings by a Burrows-Wheeler transform.

Which 200-byte windows of the corpus occur twice is decided by threshold-bounded interval expansion: on the transform of
a text, breadth-first backward extension finds suffix-array boundaries by increasing common prefix and stops at 200, so
what it leaves undivided are the windows that are equal.

One transform cannot hold the corpus, so windows are dealt so that equal ones meet. Each window has an anchor: the
smallest hash among its 48-byte substrings, which depends on its content alone. The windows of a document that share an
anchor are one region. Only regions whose anchor occurs elsewhere too go on; equal regions are counted and sent once;
regions with one anchor are transformed together. The different regions of an anchor in more contexts than a transform
takes are dealt anew by anchors of 184 and then of 200 bytes, again only where those occur twice: every window reaches a
transform, and no group grows with the corpus, since a region with an anchor as long as a window is that window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, discard, doc_frame, per_row, written

LENGTH = 200
GRAM = 48
#: Bytes by which the anchors of the next levels fall short of a window.
SHORT = (16, 0)
#: Bytes that are anchored at once, and bytes that one transform holds.
SEGMENT, TRANSFORM = 1 << 18, 1 << 19
#: Different regions of one anchor that are transformed as they are; with the bytes that a region has at most, they
#: bound what a transform holds beyond TRANSFORM. More are dealt anew. Results do not depend on it.
REGIONS = 256

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x5851F42D4C957F2D


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse."""

    def __init__(self, n: int) -> None:
        self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        self.byte = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


_powers: dict[int, Powers] = {}


def _powers_for(n: int) -> Powers:
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = Powers(size)
    return _powers[size]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchored(data: np.ndarray, lengths: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Regions of the texts of ``lengths`` that ``data`` holds one after another.

    (text, first window, windows, anchor hash, region hash). Every window of ``length`` bytes within a text is in one
    region, and equal windows have equal anchor hashes.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    p = _powers_for(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(p.byte[data] * p.up[:n], out=prefix[1:])
    h = _mix((prefix[gram:] - prefix[:-gram]) * p.down[: n - gram + 1])
    at = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    least = _least((h & ~low) | (low - at), length - gram + 1)  # of equal hashes the last
    where = (low - (least & low)).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths - length + 1, 0))
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(lengths - length + 1, 0)) - np.maximum(lengths - length + 1, 0), np.maximum(lengths - length + 1, 0))
    window = starts[owner] + inner
    if not len(window):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    spot = where[window]
    first = np.flatnonzero(np.concatenate(([True], (spot[1:] != spot[:-1]) | (owner[1:] != owner[:-1]))))
    count = np.diff(np.append(first, len(window)))
    begin = window[first]
    end = begin + count + length - 1
    region = _mix((prefix[end] - prefix[begin]) * p.down[begin] + (end - begin).astype(np.uint64) * _STEP)
    return owner[first], inner[first], count, h[spot[first]], region


ANCHORS = T.StructType([T.StructField("h", T.LongType()), T.StructField("r", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("tag", T.LongType()), T.StructField("spot", T.LongType())])


def _segments(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, list[int], list[int], np.ndarray]]:
    """(bytes, row of each piece, where in its text each piece begins, lengths); long texts come in overlapping pieces."""
    parts: list[bytes] = []
    rows: list[int] = []
    begins: list[int] = []
    size = 0
    for row, text in enumerate(batch.column("text").to_pylist()):
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, SEGMENT):
            parts.append(text[at : at + SEGMENT + length - 1])
            rows.append(row)
            begins.append(at)
            size += len(parts[-1])
            if size >= SEGMENT:
                yield np.frombuffer(b"".join(parts), np.uint8), rows, begins, np.array([len(x) for x in parts], np.int64)
                parts, rows, begins, size = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), rows, begins, np.array([len(x) for x in parts], np.int64)


def _anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column("doc_id"), batch.column("tag")
            for data, of, begins, lengths in _segments(batch, length):
                owner, inner, count, h, r = anchored(data, lengths, length, gram)
                row = pa.array(np.array(of, np.int64)[owner])
                spot = (np.array(begins, np.int64)[owner] + inner) << 8 | (count - 1)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(r.view(np.int64)), ids.take(row), tags.take(row), pa.array(spot)], names=ANCHORS.names)

    return rows.select("doc_id", "tag", "text").mapInArrow(run, ANCHORS)


def sort_rotations(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(rotations of ``s`` in order of their first ``depth`` bytes, what their first 8 differ by from the one before).

    Sorted by doubling; those still equal stand in any order.
    """
    n = len(s)
    wide = np.concatenate((s, np.resize(s, 8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(min(8, depth)):
        key = key << np.uint64(8) | wide[k : n + k]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    apart = np.concatenate((key[:1], key[1:] ^ key[:-1]))
    edge = apart != 0
    edge[0] = True
    del key, wide
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(edge)[np.cumsum(edge, dtype=np.int32) - 1]
    done = min(8, depth)
    while done < depth:
        step = min(done, depth - done)
        slots = np.flatnonzero(~(edge & np.append(edge[1:], True))).astype(np.int32)
        if not len(slots):
            break
        at = order[slots]
        key = rank[at].astype(np.int64) * n + rank[(at + step) % n]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        edge[slots] = np.concatenate(([True], key[1:] != key[:-1]))
        starts = slots[edge[slots]]  # every group of equals lies within these slots
        rank[at] = starts[np.cumsum(edge[slots], dtype=np.int32) - 1]
        done += step
    return order, apart


def undivided(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, whether each place in it begins a new class); a class shares its first ``depth`` bytes.

    Intervals of the transform are extended to the left by every symbol, breadth first. The k-th round handles strings of
    k bytes and finds the boundaries whose neighbours share k bytes; an interval that finds none is not extended again.
    """
    n = len(s)
    order, apart = sort_rotations(s, depth)
    last = s[order - 1]  # rotation 0 is preceded by the last byte
    by = np.argsort(last, kind="stable")
    forward = np.empty(n, np.int32)
    forward[by] = np.arange(n, dtype=np.int32)
    first = last[by]
    del by
    done = min(8, depth)
    bound = np.append(apart != 0, True)
    bound[0] = True
    # After ``done`` rounds the queue holds the intervals that end where neighbours share one byte less.
    edges = np.flatnonzero(bound).astype(np.int32)
    last_byte = np.append((apart != 0) & (apart < 256), False)
    last_byte[0] = False
    here = last_byte[edges[1:]]
    low, high = edges[:-1][here], edges[1:][here]
    del apart, last_byte
    for _ in range(done, depth):
        if not len(low):
            break
        size = high - low
        owner = np.repeat(np.arange(len(low), dtype=np.int32), size)
        inside = np.arange(len(owner), dtype=np.int32) + np.repeat((low - np.cumsum(size) + size).astype(np.int32), size)
        # Intervals stand in order, so sorting stably by the preceding byte sorts what they map to.
        turn = np.argsort(last[inside], kind="stable")
        to, owner = forward[inside[turn]], owner[turn]
        del inside, turn
        new = np.empty(len(to), bool)
        new[0] = True
        new[1:] = owner[1:] != owner[:-1]
        symbol = first[to]
        new[1:] |= symbol[1:] != symbol[:-1]
        begin = np.flatnonzero(new)
        end = to[np.append(begin[1:], len(to)) - 1] + 1
        fresh = ~bound[end]
        low, high = to[begin[fresh]], end[fresh]
        bound[high] = True
    return order, bound[:-1]


def repeated(regions: list[bytes], copies: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each region, which of its windows of ``length`` bytes occur twice or more among all regions and copies."""
    s = np.frombuffer(b"\xff".join([*regions, b""]), np.uint8)  # the byte 255 is in no UTF-8 text
    sizes = np.array([len(x) for x in regions], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    weight = np.zeros(len(s), np.int32)
    for a, n, k in zip(starts.tolist(), sizes.tolist(), copies.tolist()):
        weight[a : a + max(0, n - length + 1)] = min(k, 2)
    order, begins = undivided(s, length)
    total = np.add.reduceat(weight[order], np.flatnonzero(begins), dtype=np.int64)
    twice = np.empty(len(s), bool)
    twice[order] = (total >= 2)[np.cumsum(begins) - 1]
    return [twice[a : a + max(0, n - length + 1)] for a, n in zip(starts.tolist(), sizes.tolist())]


def _runs(mask: np.ndarray) -> list[int]:
    """[first, last + 1, ...] of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge).tolist()


def _transformed(length: int):
    """Rows sorted by anchor; as many whole anchors at once as a transform holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        size = 0

        def solve(part: list[tuple]) -> list[tuple]:
            masks = repeated([x[3] for x in part], np.array([x[2] for x in part]), length)
            return [(h, r, _runs(m)) for (h, r, _, _), m in zip(part, masks) if m.any()]

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "r", "copies", "text"))):
                if held and row[:2] == held[-1][:2]:
                    continue
                if size >= TRANSFORM and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) + 1
        if held:
            yield solve(held)

    return run


def _transform(regions: DataFrame, length: int) -> DataFrame:
    """(h, r, runs): for each of ``regions`` (h, r, copies, text) with one, the runs of its windows that occur twice."""
    total = regions.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // (4 * TRANSFORM)))
    dealt = regions.select("h", "r", "copies", "text").repartition(parts, "h").sortWithinPartitions("h", "r")
    return arrow_map(dealt, _transformed(length), "h long, r long, runs array<int>")


CUT = T.StructType([T.StructField(c, T.LongType()) for c in ("h2", "r2", "h", "r", "copies", "at", "n")])


def _cut(regions: DataFrame, length: int, gram: int) -> DataFrame:
    """Each region's windows by their anchor of ``gram`` bytes: (h2, r2, h, r, copies, first window, windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of in range(0, batch.num_rows, 500):
                part = batch.slice(of, 500)
                texts = part.column("text").to_pylist()
                owner, inner, count, h2, r2 = anchored(np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts], np.int64), length, gram)
                row = pa.array(owner)
                mine = [part.column(c).take(row) for c in ("h", "r", "copies")]
                yield pa.RecordBatch.from_arrays([pa.array(h2.view(np.int64)), pa.array(r2.view(np.int64)), *mine, pa.array(inner.astype(np.int64)), pa.array(count.astype(np.int64))], names=CUT.names)

    return regions.select("h", "r", "copies", "text").mapInArrow(run, CUT)


def _decided(regions: DataFrame, length: int, short: tuple[int, ...]) -> DataFrame:
    """(h, r, runs) of the written table ``regions`` (h, r, copies, text), crowded anchors dealt anew by longer ones."""
    crowded = regions.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > REGIONS).select("h")
    if not short or (crowded := written(crowded, "crowded")).isEmpty():
        return _transform(regions, length)
    many = written(regions.join(crowded, "h", "left_semi"), "many")
    pieces = written(_cut(many, length, length - short[0]), "pieces")
    often = written(pieces.groupBy("h2").agg(F.sum("copies").alias("n")).where("n > 1").select("h2"), "often")
    shared = written(pieces.join(often, "h2"), "shared")
    discard(pieces, often)
    one = shared.groupBy("h2", "r2").agg(F.sum("copies").alias("copies"), F.min(F.struct("h", "r", "at", "n")).alias("of"))
    one = one.select("h2", "r2", F.col("copies").alias("all"), "of.*").join(many.select("h", "r", "text"), ["h", "r"])
    text = F.expr(f"substring(text, cast(at as int) + 1, cast(n as int) + {length - 1})")
    next_ = written(one.select(F.col("h2").alias("h"), F.col("r2").alias("r"), F.col("all").alias("copies"), text.alias("text")), "regions")
    discard(many)
    found = _decided(next_, length, short[1:]).select(F.col("h").alias("h2"), F.col("r").alias("r2"), "runs")
    back = shared.join(found, ["h2", "r2"]).select("h", "r", F.transform("runs", lambda x: x + F.col("at").cast("int")).alias("runs"))
    back = written(back.groupBy("h", "r").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")
    discard(shared, next_)
    return _transform(regions.join(crowded, "h", "left_anti"), length).union(back)


def repeated_ranges(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, tag, ranges): for each text with one, [first, last + 1, ...] of its windows that also start elsewhere."""
    anchors = written(_anchors(rows, length, gram), "anchors")
    often = written(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "often")
    shared = written(anchors.join(often, "h"), "shared")
    discard(anchors, often)

    regions = shared.groupBy("h", "r").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "tag", "spot")).alias("at"))
    at = regions.select("h", "r", "copies", F.col("at.doc_id").alias("of"), F.col("at.tag").alias("with"), "at.spot")
    joined = rows.join(at, rows["doc_id"].eqNullSafe(at["of"]) & (rows["tag"] == at["with"]))
    text = F.expr(f"substring(text, cast(shiftright(spot, 8) as int) + 1, cast((spot & 255) as int) + {length})")
    # Repeated rows give their regions more than once, which changes nothing: such regions have two copies at least.
    regions = written(joined.select("h", "r", "copies", text.alias("text")), "regions")
    found = _decided(regions, length, tuple(x for x in SHORT if x < length - gram))
    hits = shared.join(found, ["h", "r"]).select("doc_id", "tag", F.transform("runs", lambda x: x + F.shiftright("spot", 8)).alias("ranges"))
    return hits.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def removal(n: int, ranges: list[int] | None, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of bytes that the windows in ``ranges`` cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(ranges[::2], ranges[1::2])) if ranges else ():
        b += length - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return text
    cuts = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, spans, text) for every row: the removed runs [a, b) and the bytes that are left.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else goes; strings are judged on the
    input, overlaps count, and matches stay within a document. Null and empty texts are empty. Repeated rows are
    documents of their own, so all that is longer than ``length`` goes from each. Ids may be null or repeat. An empty
    table gives an empty result.
    """
    rows = doc_frame(docs, id_col, text_col).withColumn("tag", F.xxhash64("text"))
    ranges = repeated_ranges(rows, length, gram)
    ranges = ranges.select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"), "ranges")
    joined = rows.join(ranges, rows["doc_id"].eqNullSafe(ranges["_doc"]) & (rows["tag"] == ranges["_tag"]), "left").select("doc_id", "text", "ranges")

    def cut(doc_id, text, ranges):
        spans = removal(len(text), ranges, length)
        return doc_id, len(text), [{"a": a, "b": b} for a, b in spans], without(text, spans)

    return per_row(joined, cut, "doc_id long, n_bytes long, spans array<struct<a:int,b:int>>, text binary")

