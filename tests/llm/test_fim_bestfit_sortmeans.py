import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import bestfit, fim, sortmeans
from cohortflow.llm.queries import tokenizer_path


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 fill-in-middle


def plain_fim(doc_id, text, p=fim.Params()):  # noqa: B008
    text = text or ""
    tokens = re.findall(p.token, text, re.S)
    n = len(tokens)
    h = sha(p.seed + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in p.marks) or h3 % 100 >= 100 - p.plain:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (tokens[:lo], tokens[lo:hi], tokens[hi:]))
    a, b, c = p.marks
    if h4 % 100 < p.spm:
        return n, "spm", len(pre), len(mid), b + suf + a + pre + c + mid
    return n, "psm", len(pre), len(mid), a + pre + b + suf + c + mid


ODD_TEXTS = ["", None, " ", "a", "<", "<P", "P>", "x<P>y", "<M>", "<S>", "a<S b<M c<P", "<<S>>", "é́‍\U0001f469‍\U0001f4bb don't 12", "a\nb\r\tc\x00d", "'quoted' \"text\" \\ %", "日本語" * 40, "z" * 5000, "1 2 " * 30_000]


@pytest.fixture(scope="module")
def fim_rows():
    rows = [(i * 100 + k, t) for i, t in enumerate(ODD_TEXTS) for k in range(12)]
    return rows + [(None, "no id here"), (None, None), (7, "twice the same"), (7, "twice the same"), (-3, "below zero")]


@pytest.fixture(scope="module")
def fim_docs(spark, fim_rows):
    frame = spark.createDataFrame(fim_rows, "doc_id long, text string").repartition(3)
    return frame.withColumns({c: F.lit("x") for c in ("output", "form", "n", "h", "tokens", "batch")})


def test_fim_texts_and_back(fim_docs, fim_rows):
    made = fim.transform(fim_docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: repr(tuple(r))
    assert sorted(made.collect(), key=key) == sorted([(i, *plain_fim(i, t)) for i, t in fim_rows], key=key)
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
    back = fim.restore(made)
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t in fim_rows)


def test_fim_digests(spark, data, fim_docs, fim_rows, none):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    docs = fim_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    want = Counter((i, n, form, a, b, sha(out), sha(t or "")) for i, t in rows + fim_rows for n, form, a, b, out in [plain_fim(i, t)])
    assert Counter(map(tuple, fim.digests(docs).collect())) == want
    assert fim.digests(none).count() == 0 and fim.transform(none).count() == 0


def test_fim_parameters(spark):
    p = fim.Params(token="[0-9]+|[^0-9]", marks=("(pre)", "(it's suf)", "[mid]"), seed="s'", plain=0, spm=50)
    rows = [(f"id{i}", f"{i} and {i * i} more") for i in range(60)]
    made = fim.transform(spark.createDataFrame(rows, "name string, body string"), p, "name", "body")
    assert sorted(map(tuple, made.collect())) == sorted((i, *plain_fim(i, t, p)) for i, t in rows)
    assert sorted(map(tuple, fim.restore(made, p).collect())) == sorted(rows)
    for marks in (("", "b", "c"), ("ab", "bc", "d"), ("ab", "b", "c"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fim.Params(marks=marks)


# 12 best-fit packing


def one_by_one(lengths, window):
    """Best-two-fit, a sequence at a time, on a plain list."""
    left, out = sorted(lengths), []

    def fill(bin_):
        while fitting := [x for x in left if x <= window - sum(bin_)]:
            left.remove(fitting[-1])
            bin_.append(fitting[-1])

    while left:
        bin_: list = []
        fill(bin_)
        smallest, room = min(bin_), window - sum(bin_) + min(bin_)
        if len(bin_) > 1 and sum(bin_) < window:
            pairs = [(a + b, a, b) for j, a in enumerate(left) for b in left[:j] if a + b <= room]
            total, a, b = max(pairs, default=(0, 0, 0))
            if total > smallest:
                bin_.remove(smallest)
                left.remove(a), left.remove(b)
                left.append(smallest)
                left.sort()
                bin_ += [a, b]
                fill(bin_)
        out.append(sorted(bin_))
    return sorted(out)


def packed(lengths, window):
    counts = np.bincount(lengths, minlength=window + 1)
    order, number = np.argsort(lengths, kind="stable"), np.empty(len(lengths), np.int64)
    number[order] = np.arange(len(lengths)) - (np.cumsum(counts) - counts)[lengths[order]]
    out = defaultdict(list)
    for s, at, n in sorted(zip(*(x.tolist() for x in bestfit.places(bestfit.plan(counts, window), lengths, number)), lengths.tolist(), strict=True)):
        assert at == sum(out[s])
        out[s].append(n)
    return sorted(map(sorted, out.values()))


def test_best_two_fit_equals_one_sequence_at_a_time():
    rng, swaps = np.random.default_rng(1), 0
    for trial in range(120):
        window = int(rng.integers(5, 60))
        lengths = rng.integers(1, window + 1, rng.integers(1, 150))
        if trial % 3 == 0:
            lengths = np.minimum(lengths, rng.integers(1, window + 1))
        got = packed(lengths, window)
        assert got == one_by_one(lengths.tolist(), window)
        assert all(sum(x) <= window for x in got)
    # greedy alone: 6 + 3, then 5 + 5; with the swap 6 + 2 + 2 and 5 + 5, 3 left over
    assert packed(np.array([6, 3, 2, 2, 5, 5]), 10) == [[2, 2, 6], [3], [5, 5]]


def test_best_two_fit_is_tight_at_size():
    rng = np.random.default_rng(2)
    lengths = np.concatenate([rng.integers(1, 1025, 40_000), np.full(20_000, 300), np.minimum(1024, rng.geometric(1 / 80, 40_000))])
    rows = bestfit.plan(np.bincount(lengths, minlength=1025), 1024)
    bins = int((rows["sequence"] + -(-(rows["hi"] - rows["lo"]) // rows["per"])).max())
    assert lengths.sum() / 1024 <= bins <= 1.002 * lengths.sum() / 1024 + 1 and len(rows["lo"]) < 3 * 1024 * 45


def check_pieces(rows, want, window):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r), by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        ids, at = want[i], 0
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // window)))
        assert all(r.length == window for r in pieces[1:])
        for r in pieces:
            assert r.start == at and 0 < r.length <= window
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(by_seq)


def byte_ids(texts, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, *[end] * (end is not None)] for i, x in texts.items()}


def test_bestfit(spark, docs, texts, none, odd):
    path = tokenizer_path("byte_bpe_50k.json")
    want = byte_ids(texts)
    used = check_pieces(bestfit.pack(docs, path).collect(), want, 1024)
    assert used <= -(-sum(map(len, want.values())) // 1024) + 1
    assert bestfit.pack(none, path).count() == 0
    assert sorted(r.doc_id or -1 for r in bestfit.pack(odd, path).where("piece = 0").collect()) == [-1, -1, 7, 7, 7, 8, 8]


def test_bestfit_on_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = byte_ids({r.doc_id: r.text for r in docs.collect()})
    used = check_pieces(bestfit.pack(docs, tokenizer_path("byte_bpe_50k.json")).collect(), want, 1024)
    rest = [n % 1024 for n in map(len, want.values()) if n % 1024]
    whole = sum(n // 1024 for n in map(len, want.values()))
    assert used == whole + len(packed(np.array(rest), 1024))


def test_bestfit_cuts_specials_and_tokens(spark):
    """Small windows, exact multiples, special tokens in a text, starts joined by shuffle, ids given back."""
    path = tokenizer_path("byte_bpe_50k.json")
    rng = random.Random(5)
    texts = {i: " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(40))) for i in range(300)} | {900: "a<|endoftext|>b", 901: "one two three", 902: ""}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("length", F.lit("x")).repartition(7)
    for window in (1, 2, 4, 64):
        check_pieces(bestfit.pack(frame, path, window=window).collect(), byte_ids(texts), window)
    rows = bestfit.pack(frame, path, window=16, end_id=None, tokens=True).collect()
    want = {i: x for i, x in byte_ids(texts, None).items() if x}
    assert 50256 in want[900]
    check_pieces(rows, want, 16)
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.piece):
        got[r.doc_id] += r.ids
    assert got == want


def test_bestfit_starts_by_shuffle(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(bestfit, "BROADCAST_STARTS", 0)
    check_pieces(bestfit.pack(docs, tokenizer_path("byte_bpe_50k.json")).collect(), byte_ids(texts), 1024)


# 13 centroid clustering


def plain_means(vectors, p):
    """vectors: {id: list}; all distances, whole numbers of any size."""
    points = {}
    for i, v in vectors.items():
        if v is not None and len(v) == p.dimension and all(x is not None and np.isfinite(x) for x in v):
            points[i] = [int(np.floor(p.scale * float(x))) for x in v]
    centroids = [points[i] for i in sorted(points, key=lambda i: sha(f"{p.seed}{i}"))[: p.clusters]]

    def assign():
        return {i: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for i, v in points.items()}

    for _ in range(p.rounds):
        found = defaultdict(list)
        for i, (_, k) in assign().items():
            found[k].append(points[i])
        for k, mine in found.items():
            centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    last = assign()
    inertia = Counter()
    for d, k in last.values():
        inertia[k] += d
    return {i: (k, d, inertia[k], inertia.total(), sha(",".join(map(str, centroids[k])))) for i, (d, k) in last.items()}


def check_clusters(frame, vectors, p):
    got = {r.vec_id: tuple(r)[1:] for r in sortmeans.cluster(frame, p).collect()}
    assert got == plain_means(vectors, p)


def test_sortmeans(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((7, 8)) * 3
    vectors = {i: (centres[i % 7] + rng.standard_normal(8)).tolist() for i in range(500)}
    vectors |= {600 + i: vectors[3] for i in range(30)}  # copies
    vectors |= {700 + i: [float(x) for x in rng.integers(-2, 3, 8)] for i in range(200)}  # many equal distances
    bad = [None, [], [1.0] * 7, [None] + [1.0] * 7, [float("nan")] * 8, [float("-inf")] + [0.0] * 7]
    vectors |= {1000 + i: v for i, v in enumerate(bad)} | {1100: [0.0] * 8, 1101: [1e-300] * 8, 1102: [-1e-300] * 8, 1103: [3e5] * 8}
    frame = spark.createDataFrame([(i, v, "x", 3) for i, v in vectors.items()], "vec_id long, embedding array<double>, cluster string, v int").repartition(4)
    for clusters, rounds in ((12, 5), (1, 2), (40, 0), (3, 8)):
        check_clusters(frame, vectors, sortmeans.Params(clusters=clusters, rounds=rounds, dimension=8))


def test_sortmeans_of_few_and_odd_rows(spark):
    p = sortmeans.Params(dimension=2, clusters=4)
    few = {1: [0.5, 1.0], 2: [0.5, 1.0], 3: [-7.0, 2.0]}
    frame = spark.createDataFrame(list(few.items()), "vec_id long, embedding array<float>")
    check_clusters(frame, few, p)
    assert sortmeans.cluster(frame.limit(0), p).count() == 0
    twice = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [9.0, 9.0]), (6, [1e300, 0.0])], "vec_id long, embedding array<double>")
    rows = sortmeans.cluster(twice, p).collect()
    assert Counter(r.vec_id for r in rows) == {None: 2, 5: 2} and {r.inertia for r in rows} == {0}
    far = {0: [4e6, 0.0], 1: [-4e6, 1.0], 2: [2.9e6, 2.9e6], 3: [1.0, 1.0]}
    big = spark.createDataFrame([*far.items(), (9, [4.2e6, 0.0]), (10, [-1e19, 1.0])], "vec_id long, embedding array<double>")
    check_clusters(big, far, sortmeans.Params(dimension=2, clusters=2, rounds=3))


def test_sortmeans_scans_in_order_and_stops(spark, monkeypatch):
    """Far fewer distances than all pairs, and the same assignment as all pairs."""
    rng = np.random.default_rng(7)
    centres = rng.integers(-9000, 9000, (40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + rng.integers(-300, 300, (3000, 16))).astype(np.int64)
    all_pairs = ((x[:, None] - centres[None]) ** 2).sum(2)
    seen, real = [], sortmeans.squared
    monkeypatch.setattr(sortmeans, "squared", lambda a, b: seen.append(len(a)) or real(a, b))
    cluster, distance = sortmeans.nearest(x, all_pairs.argmin(1), centres)
    assert (cluster == all_pairs.argmin(1)).all() and (distance == all_pairs.min(1)).all()
    assert sum(seen) < 40 * 40 + 2 * 3000
    cluster, distance = sortmeans.nearest(x, np.zeros(3000, int), centres)
    assert (cluster == all_pairs.argmin(1)).all() and (distance == all_pairs.min(1)).all()
