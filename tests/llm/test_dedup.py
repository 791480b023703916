import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import docs, empty, rows
from tidewheel.llm import common, embed_dedup, exact_dedup, simhash


def test_exact_against_brute_force(spark):
    for keep, best in (("largest", max), ("smallest", min)):
        for key in (exact_dedup.md5_key, lambda c: F.length(c).cast("string")):  # the second one collides
            got = [tuple(r) for r in exact_dedup.exact_duplicates(docs(spark), keep=keep, key=key).collect()]
            groups = defaultdict(list)
            for r in rows():
                groups[r[1] or ""].append(r[0])
            want = []
            for text, ids in groups.items():
                known = [i for i in ids if i is not None]
                keeper = best(known) if known else None
                left = 1
                for i in sorted(ids, key=str):
                    kept = i == keeper and left > 0
                    left -= kept
                    want.append((i, keeper, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
            assert sorted(got, key=str) == sorted(want, key=str)


def test_exact_drop_keeps_columns(spark):
    out = exact_dedup.drop_exact_duplicates(docs(spark), keep="largest")
    assert out.columns == docs(spark).columns
    assert Counter(r.text or "" for r in out.collect()) == Counter({r[1] or "": 1 for r in rows()})
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0 and exact_dedup.drop_exact_duplicates(empty(spark)).count() == 0


def brute_print(text, shingle=3, seed=42):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    parts = [b" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(p, seed) >> b & 1 for p in parts) for b in range(64)]
    return sum(1 << b for b in range(64) if parts and 2 * ones[b] > len(parts))


def brute_components(values, near):
    label = list(range(len(values)))
    while True:
        low = [min(label[j] for j in range(len(values)) if near(values[i], values[j])) for i in range(len(values))]
        if low == label:
            return label
        label = low


def test_simhash_against_brute_force(spark):
    got = sorted((str(r.doc_id), r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs(spark)).collect())
    prints = [(r[0], brute_print(r[1])) for r in rows()]
    label = brute_components([p for _, p in prints], lambda a, b: bin(a ^ b).count("1") <= 3)
    low = {k: min((i for (i, _), x in zip(prints, label, strict=True) if x == k and i is not None), default=None) for k in label}
    assert got == sorted((str(i), p, low[k]) for (i, p), k in zip(prints, label, strict=True))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def split_words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def shingles(text, n=5):
    w = split_words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def similar(a, b, least=0.8):
    return len(a & b) >= least * len(a | b)


def greedy_near_copies(table, seeds=6):
    """ids that stay of a pandas table of documents, by plain loops over the components of fingerprints."""
    table = table.sort_values("doc_id").drop_duplicates("text").reset_index(drop=True)
    data, offsets = np.frombuffer("".join(table.text).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in table.text)])
    prints = simhash.word_fingerprints(data, offsets, seeds)
    label = np.arange(len(table))
    while True:
        low = np.array([min(label[j] for j in np.flatnonzero((np.bitwise_count(prints ^ prints[i]) <= 3).any(1))) for i in range(len(table))])
        if (low == label).all():
            break
        label = low
    sets, kept = [shingles(t) for t in table.text], []
    for i in range(len(table)):
        if not any(label[j] == label[i] and similar(sets[i], sets[j]) for j in kept):
            kept.append(i)
    return set(table.doc_id[kept])


def test_near_copies_against_brute_force(spark, monkeypatch):
    kept = simhash.drop_near_duplicates(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in (1, 4, None, 7, 8, 9, 10, 11, 12, 14, 15))
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0
    rng = np.random.default_rng(21)
    stock = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(12):
        base = [stock[k] for k in rng.integers(0, 3000, rng.integers(3, 200))]
        texts.append(" ".join(base))
        for share in (0.01, 0.02, 0.04, 0.08):
            changed = list(base)
            for k in np.flatnonzero(rng.random(len(base)) < share):
                changed[k] = stock[rng.integers(0, 3000)]
            texts.append(" ".join(changed))
    import pandas as pd

    ids = rng.permutation(len(texts))
    table = pd.DataFrame({"doc_id": ids, "text": texts})
    frame = spark.createDataFrame(table).repartition(3)
    want = greedy_near_copies(table)
    for size in (simhash.GROUP_SIZE, 150):  # the second one takes the join
        monkeypatch.setattr(simhash, "GROUP_SIZE", size)
        assert {r.doc_id for r in simhash.drop_near_duplicates(frame).collect()} == want
    monkeypatch.setattr(simhash, "GROUP_ROWS", 7)
    assert {r.doc_id for r in simhash.drop_near_duplicates(frame).collect()} == want


def test_recall_of_near_copies(spark):
    """Of pairs of documents with a Jaccard similarity of 0.8 to 0.95 over five-word shingles, at most a tenth is left whole; unlike documents all stay."""
    rng = np.random.default_rng(5)
    share = 1 / np.arange(1, 4001)
    words = lambda n: rng.choice(4000, n, p=share / share.sum())
    texts, pairs = [], 0
    for _ in range(400):
        base = words(int(rng.integers(60, 400)))
        copy, goal = base.copy(), rng.uniform(0.8, 0.95)
        sets = [shingles(" ".join(f"w{k}" for k in base))]
        while True:
            more = copy.copy()
            more[rng.integers(0, len(copy))] = words(1)[0]
            new = shingles(" ".join(f"w{k}" for k in more))
            if len(new & sets[0]) / len(new | sets[0]) < goal:
                break
            copy = more
        if not (copy == base).all():
            pairs += 1
            texts += [(2 * pairs, base), (2 * pairs + 1, copy)]
    unlike = [(10_000 + i, words(int(rng.integers(60, 400)))) for i in range(300)]
    frame = spark.createDataFrame([(i, " ".join(f"w{k}" for k in t)) for i, t in texts + unlike], "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame).collect()}
    found = sum(2 * k + 1 not in kept for k in range(1, pairs + 1))
    assert pairs > 300 and found >= 0.9 * pairs, (found, pairs)
    assert all(i in kept for i, _ in unlike) and all(2 * k in kept for k in range(1, pairs + 1))


def test_simhash_drop_tells_rows_by_id_and_text(spark):
    a, b, c, d = "one clean text about rivers", "another text of quite other words", "alpha beta gamma delta epsilon", "some words that no other row has"
    table = spark.createDataFrame([(None, a), (None, b), (None, c), (None, c), (7, c), (7, d), (8, d), (9, "x y z"), (9, "x\ty z"), (9, "x y z")], "doc_id long, text string")
    for parts in (1, 4):
        kept = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(table.repartition(parts)).collect()]
        nine = [r for r in kept if r[0] == 9]
        assert len(nine) == 1 and Counter(r for r in kept if r[0] != 9) == Counter([(None, a), (None, b), (7, c), (7, d)])
        assert len(kept) == 5


def test_golay_code():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 4000)
    distance = np.bitwise_count(words.astype(np.uint64) ^ simhash._ERROR[simhash._PLACES[0][words & 255] ^ simhash._PLACES[1][words >> 8 & 255] ^ simhash._PLACES[2][words >> 16]].astype(np.uint64) ^ words.astype(np.uint64))
    assert distance.max() == 3  # the code is perfect
    keys = simhash.golay_keys(words)
    assert {len(set(k)) for k in keys.tolist()} == {1, 6}
    for bit in range(23):
        assert all(set(a) & set(b) for a, b in zip(keys.tolist(), simhash.golay_keys(words ^ (1 << bit)).tolist(), strict=True))


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
@pytest.mark.parametrize(("bucket", "blocks"), [(2, None), (256, 4), (256, 5), (256, 6)])
def test_near_links_lose_nothing(spark, bits, bucket, blocks):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(p) for p in rng.choice(64, rng.integers(1, 5), replace=False)) for b in np.repeat(base, 3)]
    values = sorted({np.uint64(x).astype(np.int64).item() for x in [*base.tolist(), *near]})
    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), bits, bucket, blocks)
    found = {r.node: r.root for r in common.components(links).collect()}
    label = brute_components(values, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= bits)
    for i, a in enumerate(values):
        for j in range(i):
            assert (found.get(a, a) == found.get(values[j], values[j])) == (label[i] == label[j])


@pytest.mark.parametrize("bucket", [2, 256])
def test_links_of_a_dense_group_stay_in_proportion_to_it(spark, bucket):
    """Before, these 481 fingerprints gave 18,755 edges by middle values alone, and 22,825 with buckets of up to 256."""
    rng = np.random.default_rng(8)
    near = {int(12345678901) ^ sum(1 << int(p) for p in rng.choice(40, rng.integers(1, 5), replace=False)) for _ in range(600)}
    far = {v ^ (2**50 - 2**44) for v in list(near)[:5]}  # six bits off
    values = sorted(near | far)
    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), 3, bucket)
    assert links.count() <= 5 * len(values)
    found = {r.node: r.root for r in common.components(links).collect()}
    label = brute_components(values, lambda a, b: bin(a ^ b).count("1") <= 3)
    assert len({(found.get(v, v), label[i]) for i, v in enumerate(values)}) == len({found.get(v, v) for v in values}) == len(set(label))


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_fingerprints_within_three_bits_share_a_key(blocks):
    rng = np.random.default_rng(blocks)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 4, 3000)], np.uint64)
    sets = []
    for prints in (a, a ^ flips):
        rows, keys = simhash.fuzzy_keys(prints, blocks)
        order = np.argsort(rows, kind="stable")
        sets.append([set(k.tolist()) for k in np.split(keys[order], np.flatnonzero(np.diff(rows[order])) + 1)])
    assert all(x & y for x, y in zip(*sets, strict=True))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (6000, 6001), (6001, 6000)]
    got = defaultdict(set)
    for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect():
        got[r.root].add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(301)), list(range(1000, 1200)), [6000, 6001]]


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 20))
    data = [(i, (v * rng.uniform(0.1, 9)).tolist(), int(i % 3)) for i, v in enumerate(np.vstack([base, *(base + rng.normal(size=base.shape) * s for s in (0.05, 0.15, 0.19, 0.2))]))]
    data += [(900, data[0][1], 0), (901, data[0][1], 0), (901, data[0][1], 0), (902, data[0][1], 1), (903, data[0][1], None), (904, None, 0), (905, [0.0] * 20, 0), (906, [float("nan")] * 20, 0), (907, [None] * 20, 0), (908, [], 0), (909, [1.0] * 5, 0), (910, [2.0] * 5, 0), (911, [1e-200] * 5, 0), (None, data[0][1], 0), (912, [float("inf")] + [1.0] * 19, 0)]
    table = spark.createDataFrame([(*d, "x", 1) for d in data], "vec_id long, embedding array<double>, label int, k string, p int")

    def near(a, b):
        (_, x, la), (_, y, lb) = data[a], data[b]
        if a == b:
            return True
        if la is None or la != lb or not x or not y or len(x) != len(y) or None in x or None in y:
            return False
        x, y = np.array(x), np.array(y)
        if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
            return False
        x, y = x / np.abs(x).max(), y / np.abs(y).max()
        return float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)) >= 0.98

    n = range(len(data))
    label = brute_components(list(n), near)
    low = {k: min((data[i][0] for i in n if label[i] == k and data[i][0] is not None), default=None) for k in label}
    want = [(data[i][0], sum(near(i, j) for j in n) - 1, low[label[i]], data[i][0] == low[label[i]]) for i in n]
    assert sorted(map(tuple, embed_dedup.similar_vectors(table).collect()), key=str) == sorted(want, key=str)
    assert embed_dedup.similar_vectors(table.limit(0)).count() == 0


def test_hot_cells_are_split(spark, monkeypatch):
    """Many points in one cell: pieces of homes meet pieces of probes, and no link is lost or counted twice."""
    monkeypatch.setattr(embed_dedup, "TILE", 7)
    rng = np.random.default_rng(12)
    base = rng.normal(size=24)
    v = np.vstack([base + rng.normal(size=(150, 24)) * 0.04, base + rng.normal(size=(60, 24)) * 0.2, rng.normal(size=(60, 24))])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    label = brute_components(list(range(len(v))), lambda a, b: a == b or near[a, b])
    table = spark.createDataFrame([(i, x.tolist(), "a") for i, x in enumerate(v)], "vec_id long, embedding array<double>, label string").repartition(3)
    got = sorted(map(tuple, embed_dedup.similar_vectors(table).collect()))
    assert got == [(i, int(near[i].sum()) - 1, label[i], label[i] == i) for i in range(len(v))]
    assert sum(g[1] for g in got) > 10_000


def test_hubs_have_their_own_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB_DEGREE", 20)
    monkeypatch.setattr(common, "HUBS", 10**9)
    edges = [(1000, i) for i in range(200)] + [(i, i + 5000) for i in range(150)] + [(9000, 9001)]
    got = defaultdict(set)
    for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect():
        got[r.root].add(r.node)
    assert sorted(map(len, got.values())) == [2, 351]


def test_scratch_deletes_but_what_is_taken_off(spark):
    with common.scratch(spark) as made:
        a, b = common.staged(spark.range(3), "a"), common.staged(spark.range(5), "b")
        kept, gone = made.pop(), made[0]
        assert a.count() == 3
    assert b.count() == 5
    fs = spark._jvm.org.apache.hadoop.fs.Path(kept).getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(spark._jvm.org.apache.hadoop.fs.Path(kept)) and not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(gone))
