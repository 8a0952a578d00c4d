"""Mixing, packing and the pipeline."""

import collections
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import mixing, packing, perplexity, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def check_mix(rows, texts_and_sources):
    sizes = collections.Counter()
    for t, s in texts_and_sources:
        sizes[s] += len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_mix_meets_its_targets_and_agrees_with_itself(spark, data, docs):
    pairs = [(r.text, r.source) for r in docs.select("text", "source").collect()]
    first = queries.op6_mixing(spark, data).collect()
    check_mix(first, pairs)
    assert {tuple(r) for r in first} == {tuple(r) for r in queries.op6_mixing(spark, data).collect()}


def test_offsets_do_not_depend_on_buckets(spark, docs, monkeypatch):
    whole = {r.doc_id: (r.taken, r.position) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 8)
    assert {r.doc_id: (r.taken, r.position) for r in mixing.mix(docs).collect()} == whole


def test_positions_invert_the_demand(docs):
    rows = mixing.mix(docs).where("taken > 0").collect()
    source = {s: k for k, s in enumerate(sorted({r.source for r in rows}))}
    by = collections.defaultdict(list)
    for r in rows:
        for at, words in zip(r.positions, r.takes):
            by[r.source].append((at, words))
    for s, takes in by.items():
        start, end = mixing.SCHEDULES[source[s] % 3]
        quota, before = sum(w for _, w in takes), 0
        for t, words in sorted(takes):
            assert 0 <= t <= 1
            assert quota * (start * t + (end - start) * t * t / 2) == pytest.approx(before, abs=1e-3 * quota + 1)
            before += words
    got = [r.position for r in mixing.mix(docs).collect() if r.position is not None]
    assert got == sorted(got)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 1000}, {"a": 0, "b": 5}, {None: 7}, {"a": 1, "b": 1, "c": 1, "d": 1, None: 5}, {"a": 0}])
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert got == pytest.approx(plain_targets(sizes)) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_odd_tables(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    check_mix(rows, [(r.text, r.source) for r in odd.select("text", "source").collect()])
    assert mixing.mix(empty).count() == mixing.mixed_documents(empty).count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.taken
    assert +words == +taken


def test_first_words():
    assert mixing.first_words(b" a  b\tc ", 2) == b" a  b" and mixing.first_words(b"a b", 5) == b"a b" and mixing.first_words(b"a b", 0) == b""


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.resolved(packing.TOKENIZER))


def check_pack(rows, texts, tokenizer, ids_of=lambda r: r.ids_crc32):
    """texts: [(id, text)], each row a document. Pieces must cover them once and fill their sequences."""
    whole = collections.Counter()
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        whole[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    sums = {}
    for r in rows:
        by_doc[r.doc_id, r.copy, r.doc_tokens, sums.setdefault((r.doc_id, r.doc_tokens), 0)].append(r)
        by_sequence[r.sequence_id].append(r)
    encoded = {(i, t): np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in set(texts)}
    pieces = collections.Counter((r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32) for r in rows)
    covered = collections.Counter()
    for (i, start, n, total, crc), k in pieces.items():
        assert any(len(x) == total and zlib.crc32(x[start : start + n].tobytes()) == crc for (d, _), x in encoded.items() if d == i)
        covered[i, total] += n * k
    want = collections.Counter()
    for i, t in texts:
        want[i, len(encoded[i, t])] += len(encoded[i, t])
    assert covered == want
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist()
        n = sum(r.length for r in parts)
        assert n == 2048 or n < 2048 and n & (n - 1) == 0


def test_packing(spark, data, texts, tokenizer):
    check_pack(queries.op3_packing(spark, data).collect(), list(texts.items()), tokenizer)


def test_small_shards_carry_on(docs, texts, tokenizer):
    from pyspark.sql import functions as F

    rows = packing.pack(docs, shard_tokens=3000).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pack(rows, list(texts.items()), tokenizer)


def test_pack_odd_tables(odd, empty, tokenizer):
    from pyspark.sql import functions as F

    rows = packing.pack(odd).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pack(rows, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], tokenizer)
    assert packing.pack(empty).count() == 0


def test_word_tokenizer_gives_the_tokenizers_ids(tokenizer):
    rng = np.random.default_rng(1)
    odd = ["Hello, it's the 'SAVE they're I'LL x'd 12345 a_b__c!!'s <|endoftext|>x <|start <|ENDOFTEXT|>", "Éèç Ÿ Œuvre İstanbul ŉ ſ a×b ÷ Straße ẞ ΣΑΣ ς", "\x00\x1c a\x1cb \x85 x\xa0y q́ 'T̈ é ﬁ ½ ² 中文字 😀 \x7f", "", "  "]
    for _ in range(400):
        odd.append("".join(chr(int(c)) for c in rng.choice(np.concatenate((np.arange(1, 0x180), np.arange(0x300, 0x370), np.arange(0x3B0, 0x3D0), [32] * 60)), 40)))
    words = packing.WordTokenizer(packing.resolved(packing.TOKENIZER))
    for _ in range(2):
        for t, ids in zip(odd, words.encode([t.encode() for t in odd])):
            assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("terms", [None, 12])
def test_retrieval_ranks_by_bm25(terms):
    """Against BM25 over the seed's whole document, or over its heaviest terms as computed here."""
    rng = np.random.default_rng(3)
    docs = [rng.zipf(1.3, rng.integers(20, 90)).clip(0, 300).astype("<u2") for _ in range(40)]
    mean = float(np.mean([len(d) for d in docs]))
    df = np.zeros(1 << 16)
    for d in docs:
        df[np.unique(d)] += 1
    idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32)
    index = packing.Index(docs, idf, mean, terms)
    unused = np.ones(40, bool)
    unused[5] = False

    def weight(t, d):
        tf = int((docs[d] == t).sum())
        return float(idf[t]) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / mean))

    for q in range(40):
        asked = sorted(set(docs[q].tolist()), key=lambda t: -weight(t, q))
        if terms and len(asked) > terms and abs(weight(asked[terms - 1], q) - weight(asked[terms], q)) < 1e-6:
            continue  # equal terms at the border: either may be taken
        score = lambda d: sum(weight(t, d) for t in asked[:terms])  # noqa: B023, E731
        want = sorted((s for j in range(40) if j not in (q, 5) and (s := score(j)) > 0), reverse=True)[:16]
        got = index.neighbours(q, unused)
        assert [round(score(j), 3) for j in got] == [round(s, 3) for s in want]


def test_neighbours_in_a_window_are_alike(spark, data, tokenizer):
    """Documents that share a window share more of their rarer ids than documents at random."""
    data = data.replace("sf0.001", "sf0.01")
    ids = {r.doc_id: set(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    df = collections.Counter(t for s in ids.values() for t in s)
    rare = {i: {t for t in s if df[t] <= len(ids) // 50} for i, s in ids.items()}
    alike = lambda a, b: len(rare[a] & rare[b]) / max(1, min(len(rare[a]), len(rare[b])))
    windows = collections.defaultdict(list)
    for r in queries.op3_packing(spark, data).collect():
        windows[r.sequence_id].append((r.offset, r.doc_id))
    pairs = [(a[1], b[1]) for w in windows.values() for a, b in [(sorted(w)[0], x) for x in sorted(w)[1:]] if a[1] != b[1]]
    rng = np.random.default_rng(9)
    every = list(ids)
    chance = np.mean([alike(*rng.choice(every, 2, replace=False)) for _ in range(4000)])
    together = np.mean([alike(a, b) for a, b in pairs])
    print("shared rare ids: in windows", round(float(together), 3), "at random", round(float(chance), 3))
    assert together > 2 * chance


def test_powers_of_two():
    for n in (0, 1, 5, 2047, 1500):
        parts = packing.powers_of_two([(0, 3, n // 2), (1, 0, n - n // 2)] if n > 1 else [(0, 0, n)] if n else [])
        sizes = [sum(k for _, _, k in s) for s in parts]
        assert sum(sizes) == n and all(s & (s - 1) == 0 for s in sizes) and len(set(sizes)) == len(sizes)


def test_pipeline_stages(spark, data, docs, tokenizer, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, data)
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            check_pack(after.collect(), [(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()], tokenizer)
        else:
            assert sorted(after.columns) == sorted(docs.columns)
            assert after.where("n_chars <> length(text)").count() == 0
        if name == "quality_rules":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in perplexity.score_quality(docs).where("kept").collect()}
        if name == "near_dedup":
            from test_dedup import classes

            left = {r.doc_id: r.text for r in now.collect()}
            assert {r.doc_id for r in after.collect()} == {i for i, (n, c) in classes(left, 80).items() if i == c}
        if name == "mixing":
            check_sources = collections.Counter()
            for r in after.collect():
                check_sources[r.source] += len(WORD.findall(r.text))
            sizes = collections.Counter()
            for r in now.collect():
                sizes[r.source] += len(WORD.findall(r.text))
            for s, t in plain_targets(sizes).items():
                assert abs(check_sources[s] - t) <= 1
        now = after
    assert corpus_pipeline.run(spark, data).count() == now.count()
