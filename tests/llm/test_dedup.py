"""Suffix-array, near-duplicate and line dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import line_dedup, near_dedup, queries, suffix_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def removed(texts, length):
    """(n_bytes, n_removed, n_spans, sha256) for each text."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[k : k + length] for x in data for k in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(x)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(spark, data, texts):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op1_suffix_dedup(spark, data).collect()}
    assert got == dict(zip(texts, removed(texts.values(), 200)))


@pytest.mark.parametrize("length", [5, 20])
def test_interval_expansion_finds_equal_windows(length):
    rng = random.Random(length)
    for _ in range(60):
        base = bytes(rng.choice(b"abc") for _ in range(60))
        regions = [base[(a := rng.randint(0, 40)) : a + rng.randint(0, 40)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 15))) for _ in range(rng.randint(1, 8))]
        copies = np.array([rng.choice([1, 1, 2, 5_000_000_000]) for _ in regions])
        s = np.frombuffer(b"\xff".join([*regions, b""]), np.uint8)
        order, begins = suffix_dedup.undivided(s, length)
        turned = [(s.tobytes() * 3)[i : i + length] for i in order]
        assert turned == sorted(turned)
        assert begins.tolist() == [i == 0 or turned[i] != turned[i - 1] for i in range(len(s))]
        count = collections.Counter()
        for x, k in zip(regions, copies.tolist()):
            count.update({w: k * n for w, n in collections.Counter(x[i : i + length] for i in range(len(x) - length + 1)).items()})
        want = [[count[x[i : i + length]] > 1 for i in range(len(x) - length + 1)] for x in regions]
        assert [m.tolist() for m in suffix_dedup.repeated(regions, copies, length)] == want


def test_anchors_cover_each_window_once_and_agree():
    rng = random.Random(3)
    for _ in range(40):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 120))) for _ in range(6)]
        found = suffix_dedup.anchored(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), 20, 6)
        anchor, region, n = {}, {}, 0
        for o, i, c, h, r in zip(*found):
            assert region.setdefault(r, texts[o][i : i + c + 19]) == texts[o][i : i + c + 19]
            for k in range(c):
                assert anchor.setdefault(texts[o][i + k : i + k + 20], h) == h
                n += 1
        assert n == sum(max(0, len(t) - 19) for t in texts)


@pytest.mark.parametrize("most", [3, 256])
def test_crowded_anchors_are_dealt_anew(spark, monkeypatch, most):
    """A passage in 600 contexts, some of which go on alike for a while, beside repeated rows and inner repeats."""
    monkeypatch.setattr(suffix_dedup, "REGIONS", most)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(330))
    noise = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    tails = [noise(60) for _ in range(4)]
    texts = [noise(rng.randint(0, 120)) + passage[: rng.randint(210, 330)] + rng.choice(tails)[: rng.choice((0, 1, 12, 20, 60))] + noise(rng.randint(0, 120)) for _ in range(600)]
    texts += [passage, passage, noise(900), "ab" * 300, passage[:150] + passage[200:], "é" * 250]
    rows = [*enumerate(texts), (5, texts[5]), (None, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_bytes - len(r.text), len(r.spans), hashlib.sha256(r.text).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == collections.Counter((i, *x) for (i, _), x in zip(rows, removed([t for _, t in rows], 200)))


def test_long_texts_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(7000))
    texts = [base, base[:2500] + "Q" + base[2600:5000], "ab" * 900, "".join(rng.choice("xyz") for _ in range(3000)), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.text), len(r.spans), hashlib.sha256(r.text).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == dict(enumerate(removed(texts, 200)))


def test_suffix_dedup_odd_tables(odd, empty):
    rows = odd.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, *x) for r, x in zip(rows, removed([r.text if r.text is None or len(r.text) < 9000 else None for r in rows], 200)) if r.text is None or len(r.text) < 9000)
    got = suffix_dedup.remove_repeats(odd).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_bytes - len(r.text), len(r.spans), hashlib.sha256(r.text).hexdigest()) for r in got if r.n_bytes < 9000) == want
    assert all(r.text == b"" for r in got if r.n_bytes > 9000)  # three copies of one text
    assert suffix_dedup.remove_repeats(empty).count() == 0


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(texts, percent=85):
    """{id: (size, least id reachable)}."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = collections.Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark, data, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_near_duplicates(spark, data).collect()}
    assert got == classes(texts)


def test_near_duplicates_of_a_large_loose_group(spark):
    """Copies of one text with 0 to 20 % of the words changed: links among copies, and chains, beside those to the base."""
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(150)]
    texts = {}
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 99999)}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    want = classes(texts)
    assert len({c for _, c in want.values()}) > 5
    assert got == want


def test_index_meets_all_pairs_under_the_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, 48)).astype("<u2")
    b = a.copy()
    for row in b:
        at = rng.choice(48, near_dedup.max_distance(9), replace=False)
        row[at] ^= 1
    assert ((near_dedup.index_keys(a, 9) == near_dedup.index_keys(b, 9)).any(axis=1)).all()


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 102), (101, 102)]
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 104)}


def test_near_duplicates_odd_tables(odd, empty):
    got = [tuple(r) for r in near_dedup.near_duplicates(odd).select("doc_id", "n_shingles", "component_id").collect()]
    count = collections.Counter(got)
    assert count[(0, 0, 0)] == count[(1, 0, 1)] == count[(2, 0, 2)] == 1 and count[(None, 0, None)] == 1
    assert count[(4, 1, 4)] == 2 and count[(5, 1, 4)] == 1
    assert {c for d, _, c in got if d in (3, 20)} == {3} and {c for d, _, c in got if d in (21, 22, 23)} == {7}  # 7 of 8 shingles
    assert len(got) == odd.count()
    kept = near_dedup.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert near_dedup.near_duplicates(empty).count() == near_dedup.keep_one_of_each(empty).count() == 0


def lines_kept(rows, least=40, docs=5):
    """[(id, n_lines, n_dropped, text)] by the contract; each row is a document."""
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (t or "").split("\n")] for _, t in rows]
    holders = collections.defaultdict(list)
    for (i, _), ks in zip(rows, keys):
        for k in set(ks):
            if len(k) >= least:
                holders[k].append(-1 if i is None else i)
    out = []
    for (i, t), ks in zip(rows, keys):
        left = [x for x, k in zip((t or "").split("\n"), ks) if not (len(holders.get(k, ())) >= docs and (-1 if i is None else i) != max(holders[k]))]
        out.append((i, len(ks), len(ks) - len(left), "\n".join(left)))
    return out


def test_line_dedup_equals_brute_force(spark, data, texts):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op7_line_dedup(spark, data).collect()}
    assert got == {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in lines_kept(list(texts.items()))}
    assert any(k for _, k, _ in got.values())


def test_line_dedup_of_a_line_in_most_documents(spark):
    """A hot line spreads over tasks that begin in its middle; the largest document keeps it, wherever it stands."""
    hot = "a line that stands in very many documents of this table"
    rng = random.Random(8)
    texts = {i: "\n".join([f"own line {i}", hot, *(f"a line that stands in some of the documents {rng.randint(0, 40):02d}" for _ in range(3)), hot]) for i in rng.sample(range(5000), 3000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: t for i, _, _, t in lines_kept(list(texts.items()))}


def test_the_stream_needs_its_order(spark):
    """The first row of a key decides, so rows out of order give other documents."""
    import pyarrow as pa

    rows = [(b"k", d, 0, 1, [0]) for d in (9, 7, 5)]

    def streamed(batches):
        yield from (pa.RecordBatch.from_pydict({"doc_id": pa.array([d for out in line_dedup._streamed([b]) for kind, _, _, d, *_ in out if kind == line_dedup.DROPPED], pa.int64())}) for b in batches)

    df = spark.createDataFrame(rows, "key binary, doc_id long, digest long, n_lines int, lines array<int>").coalesce(1)
    assert [r.doc_id for r in df.mapInArrow(streamed, "doc_id long").collect()] == [7, 5]
    assert [r.doc_id for r in df.orderBy("doc_id").coalesce(1).mapInArrow(streamed, "doc_id long").collect()] == [7, 9]


def test_line_dedup_odd_tables(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = lines_kept(rows)
    assert sum(k for _, _, k, _ in want) == 4
    got = line_dedup.dedup_lines(odd)
    assert got.columns == odd.columns
    plain = lambda i, t: (repr(i), t or "")
    assert sorted(plain(r.doc_id, r.text) for r in got.collect()) == sorted(plain(i, t) for i, _, _, t in want)
    assert line_dedup.line_bitmaps(empty).count() == line_dedup.dedup_lines(empty).count() == 0
