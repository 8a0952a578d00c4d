"""Quality rules with n-gram perplexity.

Each language has a modified Kneser-Ney model of n-grams of 1 to 4 whole code points, counted by Spark over all of its
documents: occurrences for the highest order, distinct preceding symbols for the lower ones. A document is scored by all
others: its own occurrences, and what only they add to lower orders, are taken off exactly.

The model is a set of sorted hash arrays, dealt by ranges of the hash. Every part of the documents asks for the n-grams
that it holds and is sent their statistics beside its rows, so nothing that grows with the corpus reaches the driver or
every task. Documents whose perplexity, by symbol or by word, leaves their language's band are rejected.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, code_points, discard, quoted, splits, tune, written

#: Band half-widths beyond the quartiles, in interquartile ranges of the language's own log perplexities.
FENCE = 3.0
#: Words at which a text's own length and the differences between texts add as much to the spread of log perplexities.
EVEN_WORDS = 300
#: Steps of a log perplexity by symbol, and by word, in which quartiles are counted, so that they are the same in every run.
STEPS = {"core": 1000, "word_core": 100}
#: Rules of the base verdict.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOLS)


def n_symbols(text: bytes) -> int:
    return len(text.translate(None, _NOT_SYMBOL))


def base_statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    words = text.split()
    n = len(words)
    chars = code_points(b"".join(words))
    symbols = n_symbols(text)
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        last = -1  # words before this one are counted
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, last)
                last = i + 3
    return n, chars, symbols, dup, repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words


#: The highest order of the model.
DEPTH = 4
#: Symbols in a piece of a text, and bytes that are scored at once.
PIECE = 64
AT_ONCE = 300_000
#: Ranges of the hash that the model is dealt into, as a power of two, at most.
MOST_BITS = 14
_PAD, _STOP = 0x110000, 0x110001
_LETTER = np.array([chr(c).isalnum() for c in range(128)] + [True])
_HASH = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_UNMIX = np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
_SHIFT = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWER = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(DEPTH + 1)]
_ORDER = [np.uint64((k + 1) * 0x632BE59BD9B4E019 % (1 << 64)) for k in range(DEPTH + 1)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(32))


def _unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`_mixed`."""
    x = (x ^ (x >> np.uint64(32))) * _UNMIX
    return x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))


def _symbol(x: np.ndarray) -> np.ndarray:
    return _mixed(x.astype(np.uint64) * _HASH + np.uint64(1))


def _salt(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b(b"" if lang is None else b"=" + lang.encode(), digest_size=8).digest(), "little")


class Grams:
    """The n-grams that end at each symbol of each text: hashes by order, and where each text begins.

    A text begins with a pad, which is a context but never predicted, and ends with a stop. A hash mixes a polynomial in
    the symbols, so that what an n-gram is without its first or its last symbol follows from the hash and that symbol.
    """

    def __init__(self, texts: list[bytes], langs: list[str | None]) -> None:
        points = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        self.lengths = np.fromiter((len(p) + 2 for p in points), np.int64, len(points))
        self.begins = np.cumsum(self.lengths) - self.lengths
        edge = np.array([_STOP, _PAD], np.uint32)
        self.x = x = np.concatenate([edge[1:], *(y for p in points for y in (p, edge))])[:-1]
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        salts = {lang: _salt(lang) for lang in set(langs)}
        self.salt = np.array([salts[lang] for lang in langs], np.uint64)
        h = self.salt[self.doc]
        place = np.arange(len(x)) - self.begins[self.doc]
        self.inner = place > 0
        letter = _LETTER[np.minimum(x, 128)] & (x < _PAD)
        self.word_begins = letter & ~np.append(False, letter[:-1])
        symbol = _symbol(x)
        turned = np.zeros(len(x), np.uint64)
        self.orders = [_mixed(h + _ORDER[0])]
        self.oldest = [x]
        for k in range(DEPTH):  # symbols before a text's begin are pads
            inside = place >= k
            turned = turned + (symbol if not k else np.where(inside, np.concatenate([symbol[:k], symbol[:-k]]), symbol[0])) * _POWER[k]
            self.orders.append(_mixed(h + turned + _ORDER[k + 1]))
            self.oldest.append(x if not k else np.where(inside, np.concatenate([x[:k], x[:-k]]), np.uint32(_PAD)))


def shorter(keys: np.ndarray, k: int, oldest: np.ndarray, newest: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of n-grams of order ``k`` without their first symbol, and without their last."""
    turned = _unmixed(keys) - _ORDER[k] - salt
    suffix = turned - _symbol(oldest) * _POWER[k - 1]
    context = (turned - _symbol(newest)) * _SHIFT
    return _mixed(suffix + salt + _ORDER[k - 1]), _mixed(context + salt + _ORDER[k - 1])


#: What a part says of an n-gram: how often it has it, its first and last symbol, and its language's salt.
ASKED = np.dtype([("n", "<i4"), ("oldest", "<u4"), ("newest", "<u4"), ("salt", "<u8")])
#: What the corpus says: occurrences (highest order) or distinct preceding symbols; as a context, the sum of its followers'
#: counts, and how many followers have a count of one, two, and more.
STATS = np.dtype([("n", "<i8"), ("total", "<i8"), ("one", "<i4"), ("two", "<i4"), ("more", "<i4")])


def _begins(s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)


def _first_of_each(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A place for each distinct key."""
    at, distinct = pd.factorize(keys)
    first = np.empty(len(distinct), np.int64)
    first[at] = places
    return first


def gram_counts(grams: Grams) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 0 (keys, what is asked of them), by key; pads are asked for as contexts alone, with a count of 0."""
    out = []
    places, n = np.arange(len(grams.doc)), grams.inner.astype(np.int64)
    for k in range(DEPTH, -1, -1):
        at, distinct = pd.factorize(grams.orders[k][places])
        n = np.bincount(at, n, len(distinct)).astype(np.int64)
        first = np.empty(len(distinct), np.int64)
        first[at] = places
        asked = np.empty(len(distinct), ASKED)
        asked["n"], asked["oldest"], asked["newest"], asked["salt"] = n, grams.oldest[k][first], grams.x[first], grams.salt[grams.doc[first]]
        order = np.argsort(distinct)
        out.append((distinct[order], asked[order]))
        places = first
    return out[::-1]


def summed(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys' counts added up, by key."""
    order = np.argsort(keys, kind="stable")
    keys, asked = keys[order], asked[order]
    begins = _begins(keys)
    n = np.add.reduceat(asked["n"], begins) if len(keys) else asked["n"]
    keys, asked = keys[begins], asked[begins].copy()
    asked["n"] = n
    return keys, asked


def added(keys: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys' statistics added up, by key."""
    order = np.argsort(keys, kind="stable")
    keys, stats = keys[order], stats[order]
    begins = _begins(keys)
    out = np.zeros(len(begins), STATS)
    for name in STATS.names if len(keys) else ():
        out[name] = np.add.reduceat(stats[name], begins)
    return keys[begins], out


def _kinds(n: np.ndarray) -> list[np.ndarray]:
    return [n == 1, n == 2, n > 2]


def contributions(keys: np.ndarray, k: int, n: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What distinct n-grams of order ``k`` with counts ``n`` > 0 add to the next lower order, by key."""
    suffix, context = shorter(keys, k, asked["oldest"], asked["newest"], asked["salt"])
    out = np.zeros(2 * len(keys), STATS)
    out["n"][: len(keys)] = 1
    out["total"][len(keys) :] = n
    for name, of in zip(("one", "two", "more"), _kinds(n)):
        out[name][len(keys) :] = of
    return added(np.concatenate([suffix, context]), out)


def discounts(tallies: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney's D1, D2, D3+ at index 1 to 3, from how many n-grams have a count of 1 to 4."""
    t = [float(x) for x in tallies]
    if min(t[:3]) <= 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = t[0] / (t[0] + 2 * t[1])
    d = [i - (i + 1) * y * t[i] / t[i - 1] for i in range(1, 4)]
    return np.array([0.0, *(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))])


def symbol_nats(grams: Grams, stats_of: Callable[[int, np.ndarray], np.ndarray], discount: np.ndarray) -> np.ndarray:
    """Negative log probability of each symbol of each text, 0 for pads, by all other texts.

    ``stats_of(k, keys)`` looks up what the whole corpus says of n-grams of order k. For each text, its own occurrences
    go; an n-gram that no other text has then no longer stands before its suffix, and so on down the orders.
    """
    salt = _mixed(np.arange(1, len(grams.lengths) + 1).astype(np.uint64) * _HASH)
    # for each order, the distinct (text, n-gram): where one stands, and each of the order above's (or place's) index here
    first: list[np.ndarray] = [np.zeros(0, np.int64)] * (DEPTH + 1)
    index = [np.zeros(0, np.int64)] * (DEPTH + 1)
    places = np.arange(len(grams.doc))
    for k in range(DEPTH, -1, -1):
        index[k], distinct = pd.factorize(grams.orders[k][places] ^ salt[grams.doc[places]])
        first[k] = np.empty(len(distinct), np.int64)
        first[k][index[k]] = places
        places = first[k]

    stats, context = [], [np.zeros(0, np.int64)]
    for k in range(DEPTH + 1):
        at, distinct = pd.factorize(grams.orders[k][first[k]])
        stats.append(stats_of(k, distinct)[at])
        if k:
            here = np.maximum(first[k] - 1, 0)  # the place before a pad is no context of it, but pads are not predicted
            for j in range(DEPTH, k - 2, -1):
                here = index[j][here]
            context.append(here)

    left = stats[DEPTH]["n"] - np.bincount(index[DEPTH], grams.inner, len(first[DEPTH])).astype(np.int64)
    counts: list[np.ndarray] = [np.zeros(0)] * (DEPTH + 1)
    totals: list[np.ndarray] = [np.zeros(0)] * DEPTH
    kinds: list[list[np.ndarray]] = [[]] * DEPTH
    for k in range(DEPTH, 0, -1):
        whole = np.where(grams.inner[first[k]], stats[k]["n"], 0)
        left = np.where(grams.inner[first[k]], np.maximum(left, 0), 0)
        counts[k] = left
        size = len(first[k - 1])
        totals[k - 1] = stats[k - 1]["total"] - np.bincount(context[k], whole - left, size)
        moved = np.flatnonzero(whole != left)  # elsewhere a follower's kind is what it was
        to = context[k][moved]
        kinds[k - 1] = [stats[k - 1][name] - np.bincount(to, a, size) + np.bincount(to, b, size) for name, a, b in zip(("one", "two", "more"), _kinds(whole[moved]), _kinds(left[moved]))]
        gone = (whole > 0) & (left == 0)
        left = stats[k - 1]["n"] - np.bincount(index[k - 1], gone, size).astype(np.int64)

    p = np.full(len(first[0]), 1.0 / (_STOP + 1))
    for k in range(1, DEPTH + 1):
        d, c, total = discount[k], counts[k], totals[k - 1]
        seen = total > 0
        back = np.where(seen, sum(x * y for x, y in zip(d[1:], kinds[k - 1])) / np.maximum(total, 1), 1.0)
        p = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total, 1)[context[k]] + back[context[k]] * p[index[k - 1]]
    nats = -np.log(p)[index[DEPTH]]
    nats[grams.begins] = 0
    return nats


def log_perplexities(grams: Grams, nats: np.ndarray) -> np.ndarray:
    """Rows of (by symbol, by word, core by symbol, core by word) for each text.

    The cores are over the pieces of a text between the quarters with the lowest and the highest perplexity, so that a
    quotation in another language or a long key does not decide about the text around it. A word is a run of letters
    and digits.
    """
    place = np.arange(len(nats)) - grams.begins[grams.doc]
    pieces = np.maximum((grams.lengths + PIECE // 2) // PIECE, 1)  # the rest goes to the last one
    offset = np.cumsum(pieces) - pieces
    piece = offset[grams.doc] + np.minimum(place // PIECE, pieces[grams.doc] - 1)
    doc = np.repeat(np.arange(len(pieces)), pieces)
    symbols = np.bincount(piece, place > 0, len(doc))
    words = np.bincount(piece, grams.word_begins, len(doc))
    cost = np.bincount(piece, nats, len(doc))
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((cost / np.maximum(symbols, 1), doc))] = np.arange(len(doc)) - offset[doc]
    trimmed = pieces[doc] // 4
    core = (rank >= trimmed) & (rank < pieces[doc] - trimmed)
    out = []
    for chosen in (np.ones(len(doc), bool), core):
        c, n, w = (np.bincount(doc[chosen], x[chosen], len(pieces)) for x in (cost, symbols, words))
        out += [c / np.maximum(n, 1), c / np.maximum(w, 1)]
    return np.stack(out, 1)


def _rows_at_once(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch a few rows at a time, so that tables of their n-grams fit a processor's cache."""
    sizes = pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    cut = np.cumsum(sizes + 2) // AT_ONCE
    edges = np.append(_begins(cut), len(cut))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield batch.slice(a, b - a)


def _part_counts(batches: Iterable[pa.RecordBatch]) -> list[tuple[np.ndarray, np.ndarray]]:
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[(np.zeros(0, np.uint64), np.zeros(0, ASKED))] for _ in range(DEPTH + 1)]
    join = lambda of: summed(np.concatenate([k for k, _ in of]), np.concatenate([a for _, a in of]))
    waiting = 0
    for batch in batches:
        for some in _rows_at_once(batch):
            for of, found in zip(held, gram_counts(Grams(some.column("text").to_pylist(), some.column("lang").to_pylist()))):
                of.append(found)
                waiting += len(found[0])
            if waiting > 2_000_000:
                held, waiting = [[join(of)] for of in held], 0
    return [join(of) for of in held]


def _packed(a: np.ndarray) -> bytes:
    """A structured array field by field, which compresses."""
    return zstandard.compress(b"".join(np.ascontiguousarray(a[name]).tobytes() for name in a.dtype.names), 1)


def _unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.decompress(data)
    out = np.empty(len(raw) // kind.itemsize, kind)
    at = 0
    for name in kind.names:
        field = np.frombuffer(raw, kind[name], len(out), at)
        out[name] = field
        at += field.nbytes
    return out


def _by_range(keys: np.ndarray, values: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    for i, (a, b) in enumerate(zip(edges.tolist(), [*edges[1:].tolist(), len(keys)])):
        if b > a:
            yield i, keys[a:b].tobytes(), _packed(values[a:b])


MODEL = "part long, at long, keys binary, data binary, tally array<long>"


def model_for_parts(rows: DataFrame, n: int) -> tuple[DataFrame, np.ndarray, list[DataFrame]]:
    """((part, k, keys, data): the statistics of the n-grams of order k that a part of ``rows`` holds; discounts by order; tables to discard).

    From the highest order down, a range of the hash adds up what parts have (or what the order above says), answers the
    parts, and adds to the order below. Discounts are common to all languages.
    """
    bits = min(MOST_BITS, max(4, (2 * n - 1).bit_length()))

    def ask(batches):
        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            part = first.column("part")[0].as_py()
            for k, found in enumerate(_part_counts(chain([first], batches))):
                yield [(k, part, *x) for x in _by_range(*found, bits)]

    def level(k):
        def answer(frame: pd.DataFrame) -> pd.DataFrame:
            told = frame["part"] < 0
            asked = [(part, np.frombuffer(x, np.uint64), _unpacked(y, ASKED)) for part, x, y in zip(frame["part"][~told], frame["keys"][~told], frame["data"][~told])]
            mine = [np.zeros(0, np.uint64), *(x for _, x, _ in asked)], [np.zeros(0, ASKED), *(y for _, _, y in asked)]
            keys, of = summed(*map(np.concatenate, mine))
            if k == DEPTH:
                stats = np.zeros(len(keys), STATS)
                stats["n"] = of["n"]
            else:  # every key that the order above tells of was asked for
                known, sums = added(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in frame["keys"][told])]), np.concatenate([np.zeros(0, STATS), *(_unpacked(y, STATS) for y in frame["data"][told])]))
                stats = np.zeros(len(keys), STATS)
                stats[np.searchsorted(keys, known)] = sums
            out = [(part, k, x.tobytes(), _packed(stats[np.searchsorted(keys, x)]), None) for part, x, _ in asked]
            real = stats["n"] > 0
            if k:
                out += [(-1, at, x, y, None) for at, x, y in _by_range(*contributions(keys[real], k, stats["n"][real], of[real]), bits)]
            out.append((-2, k, None, None, [int((stats["n"] == i).sum()) for i in range(1, 5)]))
            return pd.DataFrame(out, columns=["part", "at", "keys", "data", "tally"])

        return answer

    asked = written(arrow_map(rows, ask, "k long, part long, at long, keys binary, data binary"), "asked")
    tables, told, tallies = [asked], None, np.zeros((DEPTH + 1, 4), np.int64)
    for k in range(DEPTH, -1, -1):
        mine = asked.where(F.col("k") == k).select("part", "at", "keys", "data")
        found = written((mine if told is None else mine.union(told)).groupBy("at").applyInPandas(level(k), MODEL), f"order{k}")
        of = found.where("part = -2").agg(*(F.coalesce(F.sum(F.col("tally")[i]), F.lit(0)) for i in range(4))).first()
        tallies[k] = of
        told = found.where("part = -1").select("part", "at", "keys", "data")
        tables.append(found)
    discard(asked)
    answers = [t.where("part >= 0").select("part", F.col("at").alias("k"), "keys", "data") for t in tables[1:]]
    out = answers[0]
    for x in answers[1:]:
        out = out.union(x)
    return out, np.array([discounts(t) for t in tallies]), tables[1:]


SCORED = "at long, doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_perplexity double, word_log_perplexity double, core double, word_core double"
MEASURES = ("core", "word_core")


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, in column at: the part it is read in, above bit 33, and its place there."""
    return docs.withColumn("at", F.monotonically_increasing_id())


def _blobs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows as compressed pieces, for less to be dealt out."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        for some in _rows_at_once(batch) if batch.num_rows else ():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, some.schema, options=options) as out:
                out.write_batch(some)
            yield [(some.column("part")[0].as_py(), None, some.column("at")[0].as_py(), sink.getvalue().to_pybytes())]


def _scored(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Every row's statistics and perplexities, as a written table. Each part of the documents meets the model of its own n-grams."""
    tune(docs.sparkSession)
    n = max(1, splits(docs))
    chosen = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col).cast("binary"), F.lit(b"")).alias("text"), quoted(lang_col).cast("string").alias("lang"))
    rows = _numbered(chosen).select(F.shiftright("at", 33).alias("part"), "at", "doc_id", "text", "lang")
    model, discount, tables = model_for_parts(rows, n)
    texts = arrow_map(rows, _blobs, "part long, k long, at long, data binary").select("part", "k", "at", F.lit(None).cast("binary").alias("keys"), "data")

    def score(batches):
        held, order = [[] for _ in range(DEPTH + 1)], None

        def stats_of(k, wanted):
            keys, stats = order[k]
            by = np.argsort(wanted)  # in order, the search stays in the cache
            found = np.empty(len(wanted), np.int64)
            found[by] = np.minimum(np.searchsorted(keys, wanted[by]), len(keys) - 1)
            if not (keys[found] == wanted).all():
                raise ValueError("the documents changed between two readings")
            return stats[found]

        for batch in batches:
            for k, keys, data in zip(*(batch.column(c).to_pylist() for c in ("k", "keys", "data"))):
                if k is not None:
                    if order is not None:
                        held, order = [[] for _ in range(DEPTH + 1)], None
                    held[k].append((keys, data))
                    continue
                if order is None:
                    order = []
                    for of in held:
                        every = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x, _ in of)])
                        by = np.argsort(every)
                        order.append((every[by], np.concatenate([np.zeros(0, STATS), *(_unpacked(y, STATS) for _, y in of)])[by]))
                    held = []
                some = pa.ipc.open_stream(data).read_all()
                at, ids, texts, langs = (some.column(c).to_pylist() for c in ("at", "doc_id", "text", "lang"))
                grams = Grams(texts, langs)
                out = []
                for row, t, x in zip(zip(at, ids, langs), texts, log_perplexities(grams, symbol_nats(grams, stats_of, discount)).tolist()):
                    s = base_statistics(t)
                    out.append((*row, *s, base_failed(s[0], s[4]), *x))
                yield out

    # statistics sort before the rows that need them
    together = model.select("part", "k", F.lit(-1).cast("long").alias("at"), "keys", "data").union(texts.select("part", "k", "at", "keys", "data"))
    together = together.repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("part", "at").select("k", "keys", "data")
    out = written(arrow_map(together, score, SCORED), "scored")
    discard(*tables)
    return out


def _spread(n: Column) -> Column:
    """What the spread of a mean over ``n`` words goes with."""
    return F.sqrt(1 / F.greatest(n, F.lit(1)) + 1 / EVEN_WORDS)


def _quarters(rows: DataFrame, value: Column, per_unit: int, *which: int) -> DataFrame:
    """(of, q1, ...) by lang: the value that so many quarters of the rows do not exceed.

    They are exact for values in steps of 1 / ``per_unit``, by histograms, so reruns agree and no task holds all values.
    """
    steps = rows.groupBy("lang", F.floor(value * per_unit).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("lang")
    steps = steps.select("lang", "step", F.sum("n").over(whole.orderBy("step")).alias("upto"), F.sum("n").over(whole).alias("all"))
    return steps.groupBy(F.col("lang").alias("of")).agg(*((F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("step"))) / per_unit).alias(f"q{k}") for k in which))


def bands(scored: DataFrame, fence: float = FENCE) -> DataFrame:
    """(lang, and of each measure its middle, low and high): what documents that pass the base rules may differ from the middle, over :func:`_spread`.

    Low and high are the quartiles of that difference, widened.
    """
    good = scored.where(~F.col("base_failed"))
    out = None
    for c in MEASURES:
        middle = _quarters(good, F.col(c), STEPS[c], 2).select("of", F.col("q2").alias(f"{c}_middle"))
        placed = good.join(F.broadcast(middle), good["lang"].eqNullSafe(middle["of"])).drop("of")  # one row for each language
        q = _quarters(placed, (F.col(c) - F.col(f"{c}_middle")) / _spread(F.col("n_words")), STEPS[c], 1, 3)
        width = fence * (F.col("q3") - F.col("q1"))
        q = q.select(F.col("of").alias("lang"), (F.col("q1") - width).alias(f"{c}_low"), (F.col("q3") + width).alias(f"{c}_high"))
        q = q.join(middle, q["lang"].eqNullSafe(middle["of"])).drop("of")
        if out is not None:
            q = q.withColumnRenamed("lang", "of")
            q = out.join(q, out["lang"].eqNullSafe(q["of"])).drop("of")
        out = q
    return out


def _judged(scored: DataFrame, fence: float) -> DataFrame:
    """``scored`` with each document's band (low, high, word_low, word_high) and verdict."""
    limits = written(bands(scored, fence).withColumnRenamed("lang", "of"), "bands")
    out = scored.join(F.broadcast(limits), scored["lang"].eqNullSafe(limits["of"]), "left")  # one row for each language
    for c, prefix in zip(MEASURES, ("", "word_")):
        for end in ("low", "high"):
            out = out.withColumn(f"{prefix}{end}", F.col(f"{c}_middle") + F.col(f"{c}_{end}") * _spread(F.col("n_words")))
    out = out.drop("of", *(f"{c}_{x}" for c in MEASURES for x in ("middle", "low", "high")))
    inside = F.col("core").between(F.col("low"), F.col("high")) & F.col("word_core").between(F.col("word_low"), F.col("word_high"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fence: float = FENCE) -> DataFrame:
    """(doc_id, lang, base statistics, base_failed, perplexity, low, high, word_perplexity, word_low, word_high, kept) for every row.

    perplexity is per symbol and word_perplexity per word, over the whole text; the bands hold for texts' cores, see
    :func:`log_perplexities`. Null texts count as empty and fail the base
    rules; a null language is a language of its own; repeated rows are scored, and counted by the model, each time. An empty
    table gives an empty result.
    """
    out = _judged(_scored(docs, id_col, text_col, lang_col), fence)
    base = [c for c in out.columns if c not in ("at", "kept", "low", "high", "word_low", "word_high", "log_perplexity", "word_log_perplexity", *MEASURES)]
    exp = lambda c, name: F.exp(c).alias(name)
    return out.select(*base, exp("log_perplexity", "perplexity"), exp("low", "low"), exp("high", "high"), exp("word_log_perplexity", "word_perplexity"), exp("word_low", "word_low"), exp("word_high", "word_high"), "kept")


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fence: float = FENCE) -> DataFrame:
    """``docs``, all columns, without the documents that :func:`score_quality` rejects.

    Rows meet their verdicts by number, so that ids may be null or repeated.
    """
    scored = _scored(docs, id_col, text_col, lang_col)
    plain = _numbered(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))))  # no name can clash with the number's
    return plain.join(_judged(scored, fence).where("kept").select("at"), "at", "left_semi").drop("at").toDF(*docs.columns)
