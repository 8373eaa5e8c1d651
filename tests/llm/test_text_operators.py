import hashlib
import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import bpe, flat, licenses, minhash, packing, quality, spans, substring, suffix
from cohortflow.llm.queries import tokenizer_path

NONE = hashlib.sha256(b"").hexdigest()


def thue_morse(n):
    """A word and the same word with its two letters swapped: sums modulo a power of two do not tell them."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def swapped(spark, before=""):
    rows = [(i, before + x) for i, x in enumerate(y for n in (1024, 2048, 4096) for y in thue_morse(n))]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).coalesce(1), dict(rows)


def test_swapped_letters_are_other_texts(spark):
    docs, texts = swapped(spark)
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == {i: i for i in texts}
    got = {r.doc_id: r.decoded_sha256 for r in bpe.digests(docs, tokenizer_path("byte_bpe_50k.json")).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    check_packed(packing.pack(docs, tokenizer_path("word_bpe_49k.json")).collect(), ids_of(texts), 2048)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(docs).collect()} == brute.suffix(texts)
    docs, texts = swapped(spark, " ".join(f"c{i}" for i in range(34)) + " ")
    assert {r.doc_id: r.n_removed for r in substring.dedup(docs).collect()} == {i: x[1] for i, x in brute.substring(texts).items()} == dict.fromkeys(texts, 0)


def test_hashes_modulo_a_prime():
    p, rng = int(flat.PRIME), np.random.default_rng(8)
    a, b = (rng.integers(0, p, 300).astype(np.uint64) for _ in range(2))
    assert [int(x) for x in flat.times(a, b)] == [int(x) * int(y) % p for x, y in zip(a, b)]
    for values in (a, rng.integers(0, 256, 20_000).astype(np.uint8)):
        for family in (0, 1):
            sums, have, power = flat.prefix(values, family), 0, 1
            for x, v in zip(sums.tolist(), values.tolist()):
                assert x == have
                have, power = (have + (v + (values.dtype == np.uint8)) * power) % p, power * flat._BASES[family] % p


# 1 quality


def test_quality_separates_held_out_labels(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["the", "river", "flows", "past", "quiet", "hills", "and", "old", "towns"], 80)) for _ in range(200)]
    bad = [" ".join(rng.choice(["buy", "now", "$$$", "click", "free", "win", "!!!", "offer", "cheap"], 80)) for _ in range(200)]
    rows = [(i, t, int(i % 2 == 0)) for i, t in enumerate(x for pair in zip(good, bad) for x in pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit_on_labels(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    held = [r for r in quality.score(docs, model).withColumn("h", quality.held_out()).collect() if r.h]
    assert len(held) > 40 and np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in held)


def test_quality_of_odd_rows(spark, docs, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(None, 1), (3, None), (5, 1)], "doc_id long, quality int")
    model = quality.fit_on_labels(docs, labels)
    out = quality.score(docs, model)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert quality.score(odd, model).where("score between 0 and 1").count() == 7
    assert quality.score(none, model).count() == 0
    empty = quality.fit_on_labels(none, labels)
    assert {r.score for r in quality.score(odd, empty).collect()} == {0.5}


# 2 near-dedup


def test_minhash_classes(docs, texts):
    want = brute.near_classes(texts)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == want


def test_minhash_keeps_one_and_all_columns(docs, texts, odd, none):
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == set(brute.near_classes(texts).values())
    assert rows[1].text == texts[1] and rows[1].key == "k" and rows[1]._key == 5
    assert minhash.near_duplicates(odd).count() == 7 and minhash.keep_one(odd).count() == 3
    assert minhash.keep_one(none).count() == 0 and minhash.near_duplicates(none).count() == 0


def test_minhash_signatures_estimate_similarity():
    a, b = np.arange(1, 401, dtype=np.uint64), np.arange(101, 501, dtype=np.uint64)
    both = flat.mix(np.concatenate([a, b]))
    s = minhash.signatures(np.array([0, 400, 800]), both, np.ones(800), 600)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.07
    w = minhash.signatures(np.array([0, 2, 4]), flat.mix(np.array([1, 2, 1, 2], np.uint64)), np.array([3.0, 1.0, 1.0, 1.0]), 600)
    assert abs((w[0] == w[1]).mean() - 0.5) < 0.07


# 3 packing


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts.items()}


def check_packed(rows, want, window):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r), by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[i])
            assert r.ids_crc32 == zlib.crc32(np.array(want[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want[i])
    for s, pieces in by_seq.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and (at == window or s == max(by_seq))


def test_packing(docs, texts, none):
    want = ids_of(texts)
    rows = packing.pack(docs, tokenizer_path("word_bpe_49k.json")).collect()
    check_packed(rows, want, 2048)
    assert packing.pack(none, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_packing_keeps_the_mixture(docs, texts):
    mix = {"s0": 1.0, "s1": 2.0, "s2": 1.0, "": 1.0}
    rows = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), window=128, mixture=mix, quantum=1).collect()
    check_packed(rows, ids_of(texts), 128)
    filled = defaultdict(lambda: defaultdict(int))
    for r in rows:
        filled[r.sequence_id][r.queue] += r.length
    first = [filled[s] for s in range(4)]
    names = sorted(("", "s0", "s1", "s2"))
    for window in first:
        for q, name in enumerate(names):
            assert abs(window[q] - 128 * mix[name] / 5) <= 2


def test_packing_by_quanta(spark, docs, texts, odd):
    """Queues stay within a quantum of their shares; pieces do not shrink with the number of sources."""
    path = tokenizer_path("word_bpe_49k.json")
    rng = random.Random(9)
    many = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(90)), f"s{i % 60}") for i in range(600)]
    frame = spark.createDataFrame(many, "doc_id long, text string, source string").withColumn("length", F.lit("x"))
    rows = packing.pack(frame, path).collect()
    check_packed(rows, ids_of({i: t for i, t, _ in many}), 2048)
    total, paid = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in rows:
        total[r.queue] += r.length
        paid[r.sequence_id][r.queue] += r.length
    everything, done = sum(total.values()), defaultdict(int)
    for s in sorted(paid):
        for q, n in total.items():
            done[q] += paid[s][q]
            assert abs(done[q] - n * min((s + 1) * 2048, everything) / everything) <= packing.QUANTUM
    assert len(rows) < 600 * 4
    assert sorted(r.doc_id or -1 for r in packing.pack(odd, path).where("start = 0").collect()) == [-1, -1, 7, 7, 7, 8, 8]


# 4 substring dedup


def test_substring(docs, texts, none):
    want = brute.substring(texts)
    got = {r.doc_id: r for r in substring.dedup(docs, texts=True).collect()}
    assert {i: (r.n_words, r.n_removed) for i, r in got.items()} == {i: x[:2] for i, x in want.items()}
    digests = {r.doc_id: r.kept_sha256 for r in substring.dedup(docs).collect()}
    assert digests == {i: hashlib.sha256(" ".join(x[2]).encode()).hexdigest() for i, x in want.items()}
    assert substring.dedup(none).count() == 0


def test_substring_in_batches_and_with_odd_ids(docs, texts, odd):
    want = {i: x[1] for i, x in brute.substring(texts).items()}
    got = {r.doc_id: r.n_removed for r in substring.dedup(docs, batches=6).collect()}
    assert got == want  # six runs: two compactions
    assert sorted(r.n_removed for r in substring.dedup(odd).collect()) == [0, 0, 0, 0, 120, 120, 120]


def test_substring_index_reopened(spark, docs, texts):
    """A second handle, which knows only the folder and no table names, goes on with the index."""
    keyed = docs.selectExpr("doc_id AS _key", "doc_id", "text")
    part = lambda k: keyed.where(f"doc_id % 5 = {k}")
    first = substring.FingerprintIndex(spark, fanout=2, buckets=3)
    for k in range(3):
        first.append(part(k))
    for name in [*first.runs(), *first.retired]:
        spark.sql(f"DROP TABLE {name}")  # external: the files stay
    again = substring.FingerprintIndex.open(spark, first.folder)
    assert again.levels == first.levels and again.retired == first.retired and again.buckets == 3
    again.append(part(3))
    again.vacuum()
    third = substring.FingerprintIndex.open(spark, first.folder)
    assert third.retired == [] and third.levels == again.levels
    third.append(part(4))
    got = {r.doc_id: r.n_removed for r in substring.removed(keyed, third.repeated(keyed), substring.WINDOW).collect()}
    assert got == {i: x[1] for i, x in brute.substring(texts).items()}


# 6 licenses


def test_licenses(spark, none):
    filler = "some words that say nothing of licenses at all here "
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [(1, filler * 3 + apache + " " + filler), (2, filler), (3, None), (4, ""), (5, apache.upper()), (5, apache), (6, "released under the mit license " + filler), (7, "Licensed under the Apache"), (8, (filler * 2000) + "Licensed under CC BY-NC 4.0.")]
    out = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x"))).collect()}
    assert set(out) == {(1, "Apache-2.0"), (5, "Apache-2.0"), (6, "MIT"), (8, "CC-BY-NC-4.0")}
    assert out[1, "Apache-2.0"].containment == 1.0
    assert licenses.scan(none).count() == 0


def test_license_bands_find_single_runs(spark):
    """Statements of one run, at every place within a window, meet their template as often as computed."""
    p = licenses.Params()
    assert p.collision(1) > 0.998 and p.collision(4) == 1
    rng = random.Random(2)
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(i % 9)) + " licensed under cc by-nc 4.0 " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(30))) for i in range(1500)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.where("license = 'CC-BY-NC-4.0'").count() >= 1490 and found.count() < 1510
    shuffled = licenses.scan(spark.createDataFrame(rows[:200], "doc_id long, text string"), params=licenses.Params(broadcast_rows=0))
    assert shuffled.count() >= 198


def containment(text, statement):
    split = lambda t: [w.strip(licenses.MARKS) for w in (t or "").lower().split() if w.strip(licenses.MARKS)]
    runs = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    have, want = set(runs(split(text))), set(runs(split(statement)))
    return len(have & want) / len(want)


def test_licenses_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        for name in {n for n, _ in licenses.TEMPLATES}:
            best = max(containment(r.text, s) for n, s in licenses.TEMPLATES if n == name)
            if best == 1.0:
                assert (r.doc_id, name) in got
            if best < 0.8:
                assert (r.doc_id, name) not in got


# 7 byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_digests(spark, data, docs, tiktoken_encoding, none):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(docs.select("doc_id", "text")).union(spark.createDataFrame([(1, "a<|endoftext|>b  x's\u00a0\u3000y!!\n\n z"), (2, "\U0001f469\u200d\U0001f4bb e\u0301 \ufffd'LL don't")], "doc_id long, text string"))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(rows, path).collect())
    want = []
    for r in rows.collect():
        ids = tiktoken_encoding.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(none, path).count() == 0


def test_bpe_round_trip_and_split_characters(spark, docs, tiktoken_encoding):
    path = tokenizer_path("byte_bpe_50k.json")
    encoded = bpe.encode(docs, path)
    for r, t in zip(bpe.decode(encoded, path).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect(), strict=True):
        assert r.text == (t.text or "") and r.ids == tiktoken_encoding.encode_ordinary(t.text or "")
        assert [r.bytes[a:b] for a, b in zip(r.starts, r.ends)] == [tiktoken_encoding.decode_single_token_bytes(i) for i in r.ids]
    ids = tiktoken_encoding.encode_ordinary("\U0001f469")
    half = spark.createDataFrame([(1, ids[:1]), (2, ids), (3, None)], "doc_id long, ids array<int>")
    out = {r.doc_id: r.text for r in bpe.decode(half, path).collect()}
    assert out[1] and set(out[1]) == {"\ufffd"} and out[2] == "\U0001f469" and out[3] is None


# 8 suffix arrays


def test_suffix(docs, texts, none, odd):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(docs).collect()}
    assert got == brute.suffix(texts)
    assert suffix.dedup(none).count() == 0
    assert sum(r.n_removed > 0 for r in suffix.dedup(odd).collect()) == 2


def test_suffix_across_shards(spark):
    """A passage with many surroundings: its texts fill several small shards, which are merged."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = word(140)
    texts = {i: word(300) + passage + word(200) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    key = suffix.keyed(docs)
    out = suffix.removed(key, suffix.repeated(key, shard_bytes=900, columns=("doc_id",)), 100, False)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()} == brute.suffix(texts)


def test_suffix_of_a_table_not_in_order_of_ids(spark):
    """Several copies in one partition, read from the largest id down and shuffled: the smallest id keeps its text."""
    rng = np.random.default_rng(6)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    text, passage = word(400), word(180)
    texts = {i: text for i in (10, 20, 30, 40)} | {i: word(150) + passage + word(150) for i in range(50, 90, 10)}
    for ids in (sorted(texts, reverse=True), rng.permutation(sorted(texts)).tolist()):
        docs = spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string").coalesce(1)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(docs).collect()} == brute.suffix(texts)


@pytest.mark.parametrize("operator", ["suffix", "substring", "joined"])
def test_passage_in_many_surroundings(spark, monkeypatch, operator):
    """One passage in ever different surroundings is not dealt to one task, and goes all the same; joined: with more crowded
    hashes than tasks take along."""
    if operator == "joined":
        monkeypatch.setattr(spans, "BROADCAST_CROWD", 0)
    rng = np.random.default_rng(7)
    passage = [f"p{x}" for x in rng.integers(0, 10**6, 60)]
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts = {i: " ".join(word(12) + passage + word(12)) for i in range(3000)}
    ids = rng.permutation(3000).tolist()
    docs = spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string").repartition(4)
    dealt, real = [], type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, *to: dealt.append((self, to)) or real(self, *to))
    got = {r.doc_id: r for r in (suffix if operator == "suffix" else substring).dedup(docs).collect()}
    assert dealt and all(df.groupBy(to[1]).count().agg(F.max("count")).first()[0] < 300 for df, to in dealt)
    if operator == "suffix":
        assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == brute.suffix(texts)
    else:
        assert {i: (r.n_words, r.n_removed) for i, r in got.items()} == {i: x[:2] for i, x in brute.substring(texts).items()}


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(2)
    for alphabet, sizes in ((2, [30, 1, 50]), (1, [40, 40]), (200, [100])):
        data = rng.integers(0, alphabet, sum(sizes)).astype(np.uint8)
        off = np.concatenate([[0], np.cumsum(sizes)])
        end = np.repeat(off[1:], sizes)
        sa = suffix.suffix_array(data, end)
        text = [data[i : end[i]].tobytes() for i in range(len(data))]
        assert [text[i] for i in sa] == sorted(text)
        lcp = suffix.common_prefixes(data, end, sa, 1000)
        for r in range(1, len(sa)):
            a, b = text[sa[r - 1]], text[sa[r]]
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert lcp[r] == n


def test_span_keys_tell_spans():
    """Short spans by all their bytes and length, zeros included; long ones by a hash that same_bytes() proves."""
    rng = np.random.default_rng(9)
    spans = [b"\x00", b"\x00\x00", b"", b"abcdefg", b"abcdefgh", b"abcdefg\x00", b"abcdefgh\x00", *(rng.bytes(int(n)) for n in rng.integers(1, 90, 300))]
    spans += [x.encode() for x in thue_morse(2048)]
    spans += spans[::-1]
    data = np.frombuffer(b"".join(spans), np.uint8)
    end = np.cumsum([len(x) for x in spans])
    start = end - [len(x) for x in spans]
    keys = flat.span_keys(data, start, end).tolist()
    assert len(set(keys)) == len(set(spans)) and len(set(zip(keys, spans))) == len(set(spans))
    first = {x: i for i, x in reversed(list(enumerate(spans)))}
    other = np.array([first[x] for x in spans])
    assert flat.same_bytes(data, start, end, other)
    other[spans.index(b"abcdefgh\x00")] = spans.index(b"abcdefgh")
    assert not flat.same_bytes(data, start, end, other)


def test_crowded_windows_are_sent_as_digests():
    """Their bytes were sent: more than the input, in tables of crowded passages."""
    cut = np.frombuffer(b"a" * 100 + b"b" * 100 + b"a" * 100, np.uint8).reshape(3, 100)
    found = [(np.array([5, 6, 5]), np.array([1, 1, 2]), np.array([0, 7, 0]), cut)]
    gone, sent = suffix.first_windows(found)
    assert gone.column("key").to_pylist() == [2] and gone.column("cut").null_count == 1
    assert sent.column("key").to_pylist() == [1, 1] and len(set(sent.column("cut").to_pylist())) == 2 and {len(x) for x in sent.column("cut").to_pylist()} == {16}
