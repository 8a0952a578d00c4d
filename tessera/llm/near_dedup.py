"""Near-duplicate components by MinHash and a multi-index Hamming join.

A document is the set of its word shingles. Documents with equal sets are one node; each node has a signature of K b-bit
MinHash components. Signatures are split into m chunks. If two signatures differ in at most d components, some chunk
differs in at most floor(d / m) of its own, so indexing every chunk with each allowed error left out (one, here) meets
every such pair: with K = 48, m = 9, d = 17 that is every pair under the distance, and two documents at similarity 0.85
are further apart with a chance of about 1 in 10,000.

Groups of copies are never expanded into all pairs. At first only whole chunks are indexed, and a bucket's members are
compared with its hub alone, which joins most copies. Then the full index is built, and only buckets that still hold
several components go on: their members outside the largest one meet the others inside the tasks that hold the bucket,
signatures first, then full sets, and a task joins what it finds linked, so that a component is met once. Every pair
under the distance thus ends either compared on full sets or inside one component, and only links leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, doc_frame, per_row, written

WIDTH = 5
PERCENT = 85
COMPONENTS, CHUNKS = 48, 9
#: Members of a bucket, and bytes of their sets, that one task compares with as many others.
BLOCK, BLOCK_BYTES = 1024, 16 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z count as a-z."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    take = min(width, n)
    out = np.full(n - take + 1, take, np.uint64)
    for k in range(take):
        out = out * _MIX + h[k : n - take + 1 + k]
    return np.unique(_mix(out))


def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * _MIX)
    return (x[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[k:] >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray, k: int = COMPONENTS) -> np.ndarray:
    """k 16-bit components."""
    times, flip = _seeds(k)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(k, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 16_384):
        part = low[i : i + 16_384]
        least = np.minimum(least, ((part[None, :] ^ flip[:, None]) * times[:, None]).min(axis=1))
    return (_mix(least.astype(np.uint64)) >> np.uint64(48)).astype("<u2")


def max_distance(chunks: int) -> int:
    """The largest distance at which some chunk has one error at most."""
    return 2 * chunks - 1


def chunk_bounds(k: int, chunks: int) -> list[tuple[int, int]]:
    cut = [round(i * k / chunks) for i in range(chunks + 1)]
    return list(zip(cut, cut[1:]))


def index_keys(signatures: np.ndarray, chunks: int) -> np.ndarray:
    """(n, k) 64-bit keys: of each chunk, with each of its components left out."""
    n, k = signatures.shape
    out = np.empty((n, k), np.uint64)
    for c, (a, b) in enumerate(chunk_bounds(k, chunks)):
        for j in range(a, b):
            h = np.full(n, (c << 8 | j - a) + 1, np.uint64)
            for i in range(a, b):
                if i != j:
                    h = _mix(h * _MIX + signatures[:, i].astype(np.uint64))
            out[:, j] = h
    return out


SIGNED = "doc_id long, digest long, n_shingles long, node long, signature binary"


def sign(rows: DataFrame, width: int, k: int) -> DataFrame:
    """(doc_id, digest, n_shingles, node, signature); node is null for documents without words."""

    def of(doc_id, text, digest):
        s = shingles(text, width)
        if not len(s):
            return doc_id, digest, 0, None, None
        return doc_id, digest, len(s), int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "little", signed=True), signature(s, k).tobytes()

    return per_row(rows, of, SIGNED)


def chunk_keys(signatures: np.ndarray, chunks: int) -> np.ndarray:
    """(n, chunks) 64-bit keys: of each whole chunk."""
    n, k = signatures.shape
    out = np.empty((n, chunks), np.uint64)
    for c, (a, b) in enumerate(chunk_bounds(k, chunks)):
        h = np.full(n, c + 1, np.uint64)
        for i in range(a, b):
            h = _mix(h * _MIX + signatures[:, i].astype(np.uint64))
        out[:, c] = h
    return out


def _keyed(nodes: DataFrame, k: int, chunks: int, keys_of=index_keys) -> DataFrame:
    """(node, label, size, key) of ``nodes`` (node, label, size, signature)."""
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("node", "label", "size")), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            s = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(n, k)
            keys = keys_of(s, chunks)
            each = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "label", "size")), each], names=schema.names)

    return nodes.select("node", "label", "size", "signature").mapInArrow(run, schema).select("node", "label", "size", F.explode("keys").alias("key"))


def _distance(a: bytes, b: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(a, "<u2") != np.frombuffer(b, "<u2")))


def _near(pairs: DataFrame, signatures: DataFrame, most: int) -> DataFrame:
    """Those (a, b) whose signatures differ in at most ``most`` components."""
    left = signatures.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    right = signatures.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return per_row(both, lambda a, b, x, y: [(a, b)] if _distance(x, y) <= most else [], "a long, b long", many=True)


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted distinct hashes."""
    small, large = (s, t) if len(s) < len(t) else (t, s)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int(np.count_nonzero(large[at] == small))
    return 100 * common >= percent * (len(s) + len(t) - common)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").sortWithinPartitions("b")
    last: dict = {"b": None, "set": None}

    def linked(a, b, x, y):
        if last["b"] != b:
            last["b"], last["set"] = b, shingles(y, width)
        return [(a, b)] if similar(shingles(x, width), last["set"], percent) else []

    return per_row(both, linked, "a long, b long", many=True)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of the links (a, b): the least node that it reaches.

    Large-star and small-star steps in turn: each node's larger neighbours, then its smaller ones, are tied to the least
    neighbour instead. Every round removes edges that say the same, so there are never more than at first; when each
    edge leads to the least node of a star, the stars are the components. Least neighbours are written before they are
    joined: a node with very many edges can then be split over tasks. A table goes when nothing reads it any more.
    """
    a, b = F.col("a"), F.col("b")
    edges = written(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "edges")
    while True:
        least = edges.groupBy(F.col("b").alias("u")).agg(F.lit(True).alias("center"))
        inner = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "inner")
        # done when every larger end has one edge and no smaller end is some edge's larger end
        open_ = inner.where("n > 1").select("a").union(inner.join(least, inner["a"] == least["u"], "left_semi").select("a"))
        if not open_.limit(1).count():
            discard(inner)
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
            out = out.union(edges.select(F.col("b"), F.col("b")).distinct())
            out._tessera_path = edges._tessera_path
            return out
        # large star: larger neighbours v of u go to the least of u and its neighbours
        large = edges.join(inner.select(F.col("a").alias("u"), "m"), edges["b"] == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        large = written(large, "large")
        discard(edges, inner)
        # small star: u and its smaller neighbours go to the least of them
        low = written(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "low")
        small = large.join(low, large["a"] == low["u"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = written(small.select("e.a", "e.b").where("a > b").distinct(), "edges")
        discard(large, low)


def _rest(members: DataFrame, open_: DataFrame, sets: DataFrame, most: int, percent: int) -> DataFrame:
    """Links (a, b) between different components of one bucket; ``members`` are (key, node, label) of the buckets in ``open_``.

    Each member outside its bucket's largest component meets every member of another component, block against block, so
    no task holds more than two blocks of a bucket whatever its size. Members at signature distance ``most`` or less are
    compared on full sets where they meet, until they are joined.
    """
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    sizes = open_.select("key", "main", blocks(F.col("n"), F.col("bytes")).alias("across"), blocks(F.col("n") - F.col("largest"), F.col("bytes") - F.col("main_bytes")).alias("down"))
    rows = members.drop("size").join(sizes, "key").join(sets, "node")
    mine = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cell = F.xxhash64("key", "i", "j").alias("cell")
    columns = [cell, "node", "label", "signature", "shingles"]
    few = rows.where("label <> main").withColumn("i", mine(F.col("down"))).withColumn("j", every(F.col("across"))).select(*columns, F.lit(True).alias("few"))
    all_ = rows.withColumn("i", every(F.col("down"))).withColumn("j", mine(F.col("across"))).select(*columns, F.lit(False).alias("few"))

    def compare(table: pa.Table) -> pa.Table:
        label, node = table.column("label").to_numpy(), table.column("node").to_numpy()
        few = table.column("few").to_numpy(zero_copy_only=False)
        sets = table.column("shingles")
        s = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(len(node), -1)
        _, now = np.unique(label, return_inverse=True)  # component of each row, joined as links are found
        found: list[tuple[int, int]] = []
        others = np.flatnonzero(~few)
        met = s[others]
        for x in np.flatnonzero(few).tolist():
            apart = (met != s[x]).sum(axis=1)
            near = np.flatnonzero((apart <= most) & (now[others] != now[x]))
            mine = None
            for k in others[near[np.argsort(apart[near], kind="stable")]].tolist():
                if now[k] != now[x]:
                    mine = np.frombuffer(sets[x].as_py(), np.uint64) if mine is None else mine
                    if similar(mine, np.frombuffer(sets[k].as_py(), np.uint64), percent):
                        now[now == now[k]] = now[x]
                        found.append((int(node[x]), int(node[k])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return few.union(all_).groupBy("cell").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, k: int = COMPONENTS, chunks: int = CHUNKS) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id) for every row.

    Words are runs of anything but ASCII white space, A-Z lower-cased. component_id is the least id that the document
    reaches over links of ``percent`` similarity or more, itself included. Texts of fewer words than ``width`` have their
    whole sequence as one shingle; null texts and those without words have none and are linked with nothing. Repeated
    rows share a component; null ids join components but never name one, unless all of its ids are null. An empty table
    gives an empty result. digest hashes the text.
    """
    most = max_distance(chunks)
    rows = doc_frame(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))
    signed = written(sign(rows, width, k), "signed")
    nodes = signed.where("node is not null").groupBy("node").agg(F.first("signature").alias("signature"), F.first("n_shingles").alias("size"), F.min(F.struct("doc_id", "digest")).alias("at"))
    nodes = written(nodes.select("node", "signature", "size", "at.doc_id", "at.digest"), "nodes")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(node, signature, text) of the nodes ``wanted``; the rest of the corpus is not needed again."""
        at = wanted.distinct().join(nodes, "node").select("node", "signature", F.col("doc_id").alias("of"), F.col("digest").alias("with"))
        found = rows.join(at, rows["doc_id"].eqNullSafe(at["of"]) & (rows["digest"] == at["with"]))
        return written(found.select("node", "signature", "text").dropDuplicates(["node"]), "texts")

    def linked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The links among ``pairs`` (a, b), and the texts of their nodes."""
        near = written(_near(pairs, nodes.select("node", "signature"), most), "pairs")
        texts = texts_of(near.select(F.col("a").alias("node")).union(near.select("b")))
        links = written(_confirmed(near, texts.select("node", "text"), width, percent), "links")
        discard(near)
        return links, texts

    # Whole chunks: buckets' members against their hubs, which stand in the largest buckets.
    keyed = _keyed(nodes.withColumn("label", F.col("node")), k, chunks, chunk_keys).drop("label", "size")
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1")
    buckets = written(buckets, "buckets")
    members = written(keyed.join(buckets.where("n > 2").select("key", "n"), "key"), "members")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    # written, so that the join below can split a bucket of very many members
    hubs = written(members.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("hub")), "hubs")
    stars = members.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    two = lambda of: of.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    links, texts = linked(two(buckets).union(stars).distinct())
    labels = components(links)
    discard(buckets, members, hubs, links, texts)

    # The full index: what is still apart in a bucket. Of buckets with the same members one is taken.
    placed = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "size", "signature")
    keyed = _keyed(placed, k, chunks)
    marks = [F.sum(F.shiftright(F.xxhash64("node", F.lit(i)), 24)).alias(x) for i, x in enumerate("xy")]
    mixed = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.min("label").alias("least"), F.max("label").alias("most"), *marks)
    mixed = written(mixed.where("least <> most"), "mixed")
    more = mixed.where("n > 2").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    members = written(keyed.join(more, "key"), "members")
    late, texts = linked(two(mixed).distinct())
    discard(texts)

    texts = texts_of(members.select("node"))
    sets = written(per_row(texts, lambda n, g, t: (n, g, shingles(t, width).tobytes()), "node long, signature binary, shingles binary"), "sets")
    discard(texts)
    of = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.col("size")).alias("bytes"))
    size = F.struct("n", "label")
    open_ = of.groupBy("key").agg(F.max_by("label", size).alias("main"), F.max("n").alias("largest"), F.max_by("bytes", size).alias("main_bytes"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    open_ = written(open_, "open")
    more_late = written(_rest(members, open_, sets, most, percent), "late")
    every = late.union(more_late)
    if every.limit(1).count():
        # what is a star already goes in as one
        joined = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(every))
        discard(labels)
        labels = joined
    discard(late, more_late, mixed, members, open_, sets)

    placed = signed.join(labels, "node", "left").select("doc_id", "digest", "n_shingles", F.coalesce("label", "node").alias("label"))
    least = placed.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(written(least, "least"), "label", "left")
    return out.select("doc_id", "digest", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of the least id; documents without words all stay.

    Of repeated rows with that id one stays, the first by its other columns; rows with null ids that lead a component
    are treated alike.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    leads = found.where("doc_id <=> component_id").select("doc_id", "digest", "n_shingles").distinct()
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    plain = plain.withColumn("_doc", F.col(key).cast("long")).withColumn("_digest", F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))
    joined = plain.join(leads, plain["_doc"].eqNullSafe(leads["doc_id"]) & (plain["_digest"] == leads["digest"]))
    # Rows of one id and text are copies of each other. Ids are nearly always unique, so these windows are tiny; only
    # rows of a null id could gather, and they are told apart by their text.
    rank = F.row_number().over(Window.partitionBy("_doc", "_digest").orderBy(*plain.columns[: len(names)]))
    kept = joined.withColumn("_rank", rank).where("_rank = 1 or n_shingles = 0")
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


