"""Packing documents into training windows by lexical retrieval.

Documents are tokenized once into a shared table and dealt into shards by their rarest repeated tokens, so that like
meets like. Each shard holds a BM25 index over its token ids, weighted by document frequencies of the whole corpus. A
window begins with what is left of a cut document or the next unused one; the unused neighbours that the index returns
for this seed fill it, and the last of them is cut at the window's end. Nothing is left unpacked and nothing padded:
what remains at a shard's end is cut into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, doc_frame, written

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
WINDOW = 2048
#: Tokens that a shard holds; its index and ids fit a worker many times over.
SHARD_TOKENS = 2_000_000
#: BM25 parameters, and how many of a seed's heaviest terms are looked up by default.
K1, B, QUERY_TERMS = 1.2, 0.75, 12
#: Words whose ids a worker remembers at most.
CACHE_WORDS = 600_000

_tokenizers: dict = {}


#: Words of these characters alone are split here; all others go through the tokenizer whole. In this range
#: normalization changes nothing, lower-casing maps each character to one, and letters are what PIECE says.
PLAIN = re.compile("[ -~\u00c0-\u012f\u0131-\u017f]+")
#: The tokenizer's own split pattern, for plain words in lower case; MARK stands between words.
MARK = "\x01"
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|\x01|[^0-9a-z\u00df-\u00f6\u00f8-\u017f\x01]+")


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest) if b != 32}


class WordTokenizer:
    """The tokenizer's ids, word by word.

    None of its steps looks across white space (composition, lower-casing, the split pattern and merges stay within a
    word, white space itself gives no ids), so a text's ids are its words' ids in turn and a word is encoded once. Plain
    words are split into the pattern's pieces here and go through the tokenizer's merges many at once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.mark,) = self._merged([MARK]).tolist()
        self.words: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        # Lower-casing ASCII first makes words meet. It changes no id but in special tokens and before combining marks.
        split = [(t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower()).split() for t in texts]
        words = list(chain.from_iterable(split))
        known = self.words
        ids = list(map(known.get, words))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            fresh = self._words(list({words[i] for i in missing}))
            for i in missing:
                ids[i] = fresh[words[i]]
            if len(known) < CACHE_WORDS:  # the first words met stay: frequent ones are among them
                known.update(fresh)
        ends = list(accumulate(map(len, split)))
        return [b"".join(ids[a:b]) for a, b in zip([0, *ends], ends)]

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each word."""
        plain, whole = words, []
        joined = b" ".join(words)
        if any(t in joined for t in self.special) or not PLAIN.fullmatch(joined.decode("utf-8", "replace")):
            plain = []
            for w in words:
                fits = PLAIN.fullmatch(w.decode("utf-8", "replace")) and not any(t in w for t in self.special)
                (plain if fits else whole).append(w)
        out: dict[bytes, bytes] = {}
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            ids = self._merged(PIECE.findall((MARK.encode().join(part) + MARK.encode()).decode().lower()))
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part):
                raise ValueError("the tokenizer does not keep words apart")
            data, ends = ids.tobytes(), (cuts * 2).tolist()
            out.update(zip(part, [data[a:b] for a, b in zip([0, *[x + 2 for x in ends]], ends)]))
        for w, e in zip(whole, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in whole], add_special_tokens=False)):
            out[w] = np.array(e.ids, "<u2").tobytes()
        return out

    def _merged(self, pieces: list[str]) -> np.ndarray:
        """The ids of pieces, one after another, by the tokenizer's merges alone."""
        batch = [" ".join(pieces[k : k + 1000]) for k in range(0, len(pieces), 1000)]
        shown = [p.encode().decode("latin-1").translate(self.letters) for p in batch]
        return np.concatenate([np.array(e.ids, "<u2") for e in self.merges.encode_batch_fast(shown, add_special_tokens=False)])


def resolved(path: str) -> str:
    """A tokenizer's file: a bare name means the installed vocabulary, wherever this machine has it."""
    return path if os.path.dirname(path) else public_tokenizers.path(path)


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(resolved(path))
    return _tokenizers[path]


def _first(s: np.ndarray) -> np.ndarray:
    """Whether each element of a sorted array differs from the one before."""
    out = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=out[1:])
    return out


def _topic(s: np.ndarray) -> tuple[int, int]:
    """The two latest-merged, so rarest, ids that repeat in the document of sorted ids; if none does, of all its ids."""
    if not len(s):
        return 0, 0
    twice = s[1:][s[1:] == s[:-1]]
    s = twice if len(twice) else s
    top = int(s[-1])
    rest = s[: int(np.searchsorted(s, top))]
    return top, int(rest[-1]) if len(rest) else 0


TOKENS = "doc_id long, place long, first int, second int, n int, ids binary, frequencies binary"


def tokenize(rows: DataFrame, path: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """A row for each document, its ids ending with ``end_id``, and one for each task.

    A task's own row has nothing but ``frequencies``: in how many of its documents each id stands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        encode = tokenizer(path).encode
        end = np.array([end_id], "<u2").tobytes()
        total = np.zeros(1 << 16, "<u4")
        for batch in batches:
            ids, place = batch.column("doc_id").to_pylist(), batch.column("place").to_pylist()
            out = []
            for i, p, x in zip(ids, place, encode(batch.column("text").to_pylist())):
                x += end
                s = np.sort(np.frombuffer(x, "<u2"), kind="stable")
                total[s[_first(s)]] += 1
                out.append((i, p, *_topic(s), len(s), x, None))
            yield out
        yield [(None,) * 6 + (total.tobytes(),)]

    return arrow_map(rows, run, TOKENS)


def document_frequencies(tokens: DataFrame) -> DataFrame:
    """(id, n): documents that hold the id, over all documents, from the tasks' own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column("frequencies").to_pylist():
                total += np.frombuffer(x, "<u4")
        at = np.flatnonzero(total)
        yield list(zip(at.tolist(), total[at].tolist()))

    return arrow_map(tokens.where("frequencies is not null").select("frequencies"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


class Index:
    """BM25 over the documents of a shard; a document asks by its ``query_terms`` heaviest terms, or by all if None."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float, query_terms: int | None = QUERY_TERMS) -> None:
        terms, weights, owners, self.queries = [], [], [], []
        for i, ids in enumerate(docs):
            s = np.sort(ids, kind="stable")
            first = np.flatnonzero(_first(s))
            t, tf = s[first], np.diff(np.append(first, len(s)))
            w = (idf[t] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean_length)))).astype(np.float32)
            best = np.argpartition(w, -query_terms)[-query_terms:] if query_terms is not None and len(w) > query_terms else np.arange(len(w))
            self.queries.append(t[best])
            terms.append(t)
            weights.append(w)
            owners.append(np.full(len(t), i, np.int32))
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        self.weights, self.owners = np.concatenate(weights)[order], np.concatenate(owners)[order]
        self.starts = np.searchsorted(term[order], np.arange((1 << 16) + 1))
        self.scores = np.zeros(len(docs), np.float32)

    def neighbours(self, i: int, unused: np.ndarray, most: int = 16) -> list[int]:
        """The ``most`` best unused documents that share a query term with document i, best first; whoever needs more asks again."""
        scores, starts = self.scores, self.starts
        scores[:] = 0
        for t in self.queries[i].tolist():
            a, b = starts[t], starts[t + 1]
            if b - a > 1:
                scores[self.owners[a:b]] += self.weights[a:b]
        scores *= unused
        scores[i] = 0
        top = np.argpartition(scores, -most)[-most:] if len(scores) > most else np.arange(len(scores))
        top = top[np.argsort(-scores[top], kind="stable")]
        return [j for j in top.tolist() if scores[j] > 0]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW, query_terms: int | None = QUERY_TERMS) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """(full windows, the last one's pieces if it isn't full); a piece is (document, start, length)."""
    index = Index(docs, idf, mean_length, query_terms) if docs else None
    unused = np.ones(len(docs), bool)
    full: list[list[tuple[int, int, int]]] = []
    now: list[tuple[int, int, int]] = []
    room, seed, cursor = window, None, 0

    def put(i: int, at: int) -> None:
        """Document i from ``at`` on, over as many windows as it takes; what begins a window is its seed."""
        nonlocal room, now, seed
        n = len(docs[i])
        while at < n:
            take = min(room, n - at)
            if room == window:
                seed = i
            now.append((i, at, take))
            at, room = at + take, room - take
            if not room:
                full.append(now)
                now, room = [], window

    while cursor < len(docs):
        if room == window or seed is None:
            while cursor < len(docs) and not unused[cursor]:
                cursor += 1
            if cursor == len(docs):
                break
            unused[cursor] = False
            put(cursor, 0)
            continue
        begun = len(full)
        found = index.neighbours(seed, unused)
        for j in found:
            unused[j] = False
            put(j, 0)
            if len(full) > begun:
                break
        if len(full) == begun:  # no neighbours are left for this seed: the next document in key order
            while cursor < len(docs) and not unused[cursor]:
                cursor += 1
            if cursor < len(docs):
                unused[cursor] = False
                put(cursor, 0)
    return full, now


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """``pieces`` cut into sequences whose lengths are the powers of two that make up their length."""
    out, todo = [], list(reversed(pieces))
    total = sum(n for _, _, n in pieces)
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            room, now = 1 << bit, []
            while room:
                i, at, n = todo.pop()
                take = min(n, room)
                now.append((i, at, take))
                room -= take
                if take < n:
                    todo.append((i, at + take, n - take))
            out.append(now)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, query_terms: int | None = QUERY_TERMS) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset, copy), one row for each piece.

    ids: the piece's token ids as little-endian unsigned 32-bit integers. A document's ids are its text's (null: none)
    and the end id, so each has one piece at least. Sequences have ``window`` ids or a power of two of them. Each row of
    ``docs`` is a document: repeated rows are packed each and numbered by ``copy``, and a null id stays null. An empty
    table gives no pieces. ``query_terms`` bounds the terms by which a seed looks for neighbours, which changes what
    stands beside it but never what is packed; None looks by all of them, at several times the cost.
    """
    rows = doc_frame(docs, id_col, text_col)
    table = written(tokenize(rows.withColumn("place", F.xxhash64("text", "doc_id")), path), "tokens")
    tokens = table.where("frequencies is null")
    total = tokens.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    mean = total["tokens"] / max(1, total["docs"])
    idf = np.zeros(1 << 16, np.float32)
    for r in document_frequencies(table).collect():  # at most one row for each id of the vocabulary
        idf[r["id"]] = math.log(1 + (total["docs"] - r["n"] + 0.5) / (r["n"] + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # 256 KB
    shards = max(1, -(-total["tokens"] // shard_tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # (document, its copy, ids, ids of it that went into earlier shards)

        def rows_of(sequences: list[list[tuple[int, int, int]]]) -> Iterator[list[tuple]]:
            nonlocal sequence
            out: list[tuple] = []
            for pieces in sequences:
                offset = 0
                for i, at, n in pieces:
                    doc, copy, x, begun = held[i]
                    out.append((doc, begun + at, n, x[at : at + n].astype("<u4").tobytes(), begun + len(x), sequence, offset, copy))
                    offset += n
                sequence += 1
                if len(out) >= 4000:
                    yield out
                    out = []
            yield out

        size, copy, last = 0, 0, None
        for batch in batches:
            for d, place, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "place", "ids"))):
                copy = copy + 1 if last == (place, d) else 0
                last = place, d
                held.append((d, copy, np.frombuffer(x, "<u2"), 0))
                size += len(x) // 2
                if size >= 2 * shard_tokens:
                    full, rest = pack_shard([x for _, _, x, _ in held], shared.value, mean, window, query_terms)
                    yield from rows_of(full)
                    # The last pieces run to their documents' ends, so they go on as documents of the next shard.
                    held = [(*held[i][:2], held[i][2][at:], held[i][3] + at) for i, at, _ in rest]
                    size = sum(len(x) for _, _, x, _ in held)
        if held:
            full, rest = pack_shard([x for _, _, x, _ in held], shared.value, mean, window, query_terms)
            yield from rows_of(full + powers_of_two(rest))

    order = ("first", "second", "place", "doc_id")
    dealt = tokens.repartitionByRange(int(shards), *order).sortWithinPartitions(*order).select("doc_id", "place", "ids")
    return arrow_map(dealt, run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, copy long")
