"""Operators that compare documents or vectors, against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from mosaiq.llm import common, graph_search, jaccard, suffixes, vectors
from tests.llm.test_texts import words


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5001 + k) for k in range(500)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got} and all(want[n] == n for n in want if n not in got)


def variants(seed):
    """Families of texts from equal to about half alike, at sizes around the borders of the bands, and common passages."""
    rnd = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    texts = []
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 27, 28, 29, 33, 40, 60, 90, 130, 200, 300]:
        base = [rnd.choice(vocabulary) for _ in range(n)]
        texts.append(base)
        for _ in range(6):
            other = list(base)
            for _ in range(rnd.randint(0, max(1, n // 16))):
                k = rnd.randrange(len(other))
                kind = rnd.random()
                if kind < 0.5:
                    other[k] = rnd.choice(vocabulary)
                elif kind < 0.8:
                    other.insert(k, rnd.choice(vocabulary))
                elif len(other) > 1:
                    del other[k]
            texts.append(other)
        texts.append(base[: max(1, (3 * n) // 4 + 1)])
    texts += [passage + [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 60))] for _ in range(40)]
    return [(k, " ".join(t).title() if k % 3 else "\n".join(t)) for k, t in enumerate(texts)]


def linked(rows):
    sets = {}
    for k, text in rows:
        w = words(text)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {k: (len(sets[k]), c) for k, c in groups(ids, links).items()}


@pytest.mark.parametrize("seed, often, block", [(6, 512, 256), (7, 20, 3)])
def test_jaccard_components(frame, monkeypatch, seed, often, block):
    monkeypatch.setattr(jaccard, "COMMON", often)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = variants(seed) + [(900, None), (901, ""), (902, " \n ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(frame(rows, component_id=1)).collect()}
    assert got == linked(rows)


def test_signatures_meet_for_every_linked_pair():
    """Every pair at or above the threshold shares a signature, whatever features are left out as common."""
    rnd = np.random.default_rng(8)
    for n in (3, 4, 7, 23, 24, 25, 31, 32, 40, 57, 76, 101, 180, 400):
        for trial in range(12):
            a = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
            lose = int(rnd.integers(0, n // 4 + 1))
            most = int((len(a) - lose) / 0.75 - len(a)) if trial % 2 else 0
            b = np.unique(np.concatenate([rnd.permutation(a)[lose:], rnd.integers(0, 1 << 62, max(most, 0)).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared < 75 * (len(a) + len(b) - shared):
                continue
            common_ones = np.sort(rnd.permutation(a)[: int(len(a) * (0, 0.3, 1)[trial % 3])])
            sig, whose = jaccard.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), common_ones)
            assert len(a) == len(b) == shared or set(sig[whose == 0]) & set(sig[whose == 1]), (n, trial)


@pytest.mark.parametrize("block", [256, 5])
def test_open_groups_are_compared_whole(spark, block):
    """Every linking pair of different parts of a group comes out, once a piece; pairs of one part do not."""
    import pyarrow as pa

    rnd = np.random.default_rng(12)
    sets = [np.unique(rnd.integers(0, 1 << 62, int(n)).astype(np.uint64)) for n in rnd.integers(20, 90, 12)]
    sets += [np.unique(np.concatenate([a[: len(a) - len(a) // 12], rnd.integers(0, 1 << 62, len(a) // 15).astype(np.uint64)])) for a in sets for _ in range(2)]
    cards = jaccard.sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(a) for a in sets])]))
    pieces = -(-len(sets) // block)
    rows = []
    for k, (a, card) in enumerate(zip(sets, cards)):
        blk = k % pieces
        rows += [{"gid": 1, "lo": min(blk, m), "hi": max(blk, m), "blk": blk, "vertex": k, "part": k % 7, "n_shingles": len(a), "sketch": card} for m in range(pieces)]
    rows.sort(key=lambda r: (r["lo"], r["hi"], r["blk"]))
    packed = sorted(jaccard._across(iter([pa.RecordBatch.from_pylist(rows)]), 3), key=lambda b: b.column(0)[0].as_py())
    got = [tuple(p) for b in jaccard._unpacked(iter(packed)) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert len(got) == len(set(got)) and all(a % 7 != b % 7 for a, b in got)
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            shared = len(np.intersect1d(a, sets[j]))
            if i % 7 != j % 7 and 100 * shared >= 75 * (len(a) + len(sets[j]) - shared):
                assert (i, j) in got


def test_sketches_never_overstate():
    rnd = np.random.default_rng(11)
    for n in (1, 5, 33, 70, 400, 1500):
        a = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - len(a) // 5], rnd.integers(0, 1 << 62, n // 4).astype(np.uint64)]))
        x, y = jaccard.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert jaccard.least_apart(x, x) == 0
        assert jaccard.least_apart(x, y) <= len(np.setxor1d(a, b))


def test_jaccard_of_odd_documents(odd):
    got = jaccard.similar_documents(odd).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_shingles, r.component_id))
    assert by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[6] == [(1, 5)] * 2 and by[5] == [(1, 5)] and by[9][0][1] == 4
    assert by[None][0][0] == 4 and len(got) == 12
    assert jaccard.similar_documents(odd.limit(0)).count() == 0


def removed(rows):
    seen, out = set(), []
    for k, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        hit = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - 99):
            s = raw[p : p + 100]
            if s in seen:
                hit[p] += 1
                hit[p + 100] -= 1
            seen.add(s)
        inside = np.cumsum(hit)[: len(raw)] > 0
        kept = bytes(b for b, x in zip(raw, inside) if not x)
        out.append((k, len(raw), int(inside.sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2048, 3])
def test_repeats_removed(frame, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rnd = random.Random(9)
    letters = "ab cdé\n"
    pool = ["".join(rnd.choice(letters) for _ in range(rnd.randint(60, 400))) for _ in range(12)]
    rows = [(k, "".join(rnd.choice(pool)[rnd.randint(0, 50) :] if rnd.random() < 0.7 else "".join(rnd.choice(letters) for _ in range(90)) for _ in range(4))) for k in range(60)]
    rows += [(100, "z" * 350), (101, "z" * 120), (102, None), (103, ""), (104, "y" * 99), (105, pool[0][:60])]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.remove_repeats(frame(rows, kept=1)).collect())
    assert got == removed(rows)


def test_longest_previous_factors():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        n, width = int(rnd.integers(1, 40)), 8
        text = rnd.integers(97, 99, size=n + width).astype(np.uint8)
        rows = np.lib.stride_tricks.sliding_window_view(text, width)[:n].copy()
        order = rnd.permutation(n)
        want = []
        for i in range(n):
            equal = [int(np.argmax(np.append(rows[i] != rows[j], True))) for j in range(n) if order[j] < order[i]]
            want.append(max(equal, default=0))
        assert suffixes.previous_factors(rows, order).tolist() == want


def test_repeats_of_odd_documents(odd):
    got = collections.defaultdict(list)
    for r in suffixes.remove_repeats(odd).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed))
    assert got[1] == got[2] == [(0, 0)] and got[9][0][0] == got[9][0][1] and got[4][0][1] == 0 and got[7] == [(3000, 2999)]
    assert sum(map(len, got.values())) == 12
    assert suffixes.remove_repeats(odd.limit(0)).count() == 0


@pytest.fixture(scope="module")
def cloud(spark):
    rnd = np.random.default_rng(10)
    centre = rnd.standard_normal((60, 32))
    x = np.concatenate([c + rnd.standard_normal((int(rnd.integers(1, 25)), 32)) * rnd.uniform(0.02, 0.5) for c in centre] + [rnd.standard_normal((900, 32)), np.tile(centre[:1], (300, 1))])
    label = rnd.integers(0, 3, len(x))
    rows = [(k, v.astype(np.float32).tolist(), int(g)) for k, (v, g) in enumerate(zip(x, label))]
    bad = [(9001, None, 1), (9002, [0.0] * 32, 1), (9003, [float("nan")] * 32, 1), (9004, [None] + [1.0] * 31, 1), (9005, rows[0][1], None), (None, rows[0][1], 1),
           (9006, [float("inf")] * 32, 1), (9007, [1.0, 2.0], 1), (9008, [], 1)]
    return rows, spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as n_links", "2 as rank", "3 as shard")


def unit_rows(rows):
    x = np.array([r[1] for r in rows], dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("bucket", [256, 16])
def test_near_vectors(cloud, monkeypatch, bucket):
    monkeypatch.setattr(vectors, "BUCKET", bucket)
    rows, df = cloud
    x, label = unit_rows(rows), np.array([r[2] for r in rows])
    near = np.triu((x @ x.T >= 0.93) & (label[:, None] == label[None]), 1)
    a, b = np.nonzero(near)
    n = collections.Counter([*a.tolist(), *b.tolist()])
    want = groups(range(len(rows)), zip(a.tolist(), b.tolist()))
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect() if r.vec_id is not None}
    assert all(got[k].n_links == 0 and got[k].kept for k in range(9001, 9009))
    # no link that is not one, and at least 97 of 100 found
    assert all(got[k].n_links <= n[k] for k in want)
    assert sum(got[k].n_links for k in want) >= 0.97 * sum(n.values())
    assert sum(got[k].component_id == want[k] for k in want) >= 0.97 * len(want)
    assert all(got[k].kept == (got[k].component_id == k) for k in want)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("common", [0.0, 0.5, 0.8])
def test_pairs_at_the_limit_meet(spark, common):
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((3000, 96))
    x = np.sqrt(1 - common) * x / np.linalg.norm(x, axis=1, keepdims=True) + np.sqrt(common) * np.eye(96)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aim = np.roll(x, 7, axis=0)[:1000]
    aim -= (aim * x[:1000]).sum(axis=1, keepdims=True) * x[:1000]
    pairs = 0.931 * x[:1000] + np.sqrt(1 - 0.931**2) * aim / np.linalg.norm(aim, axis=1, keepdims=True)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.concatenate([x, pairs]))]
    y = unit_rows(rows)
    want = (y @ y.T >= 0.93).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert want.sum() >= 2000 and [got[k] for k in range(len(rows))] == want.tolist()


def test_nearest_vectors(cloud):
    rows, df = cloud
    x = unit_rows(rows)
    index = graph_search.build_index(df, copies=6, shard_rows=500)
    got = graph_search.nearest(index, df.where("vec_id % 20 = 0 or vec_id > 9000"), k=5).collect()
    want, have = set(), set()
    for q in range(0, len(rows), 20):
        s = x @ x[q]
        s[q] = -9
        order = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]
        want |= {(q, int(k)) for k in order}
    for r in got:
        if r.query_id < 9000:
            assert abs(r.score - x[r.query_id] @ x[r.vec_id if r.vec_id < 9000 else 0]) < 1e-9
            have.add((r.query_id, r.vec_id))
    assert len(want & have) >= 0.9 * len(want)
    assert {r["rank"] for r in got} == {1, 2, 3, 4, 5}
    assert {r.query_id for r in got if r.query_id > 9000} == {9005}  # 9007 has no other vector of its dimension
    assert graph_search.nearest(graph_search.build_index(df.limit(0), 6), df.limit(0), 5).count() == 0


def test_scores_of_tiny_and_huge_vectors_and_ids_with_several(spark):
    rnd = np.random.default_rng(12)
    base, more = rnd.normal(size=(60, 8)), rnd.normal(size=(2, 8))
    rows = [(int(k), (v * 10.0 ** s).tolist()) for k, (v, s) in enumerate(zip(base, [0, -200, 200, -310, 300] * 12))] + [(0, more[0].tolist()), (1, more[1].tolist()), (1, more[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = graph_search.nearest(graph_search.build_index(df, copies=6), df.where("vec_id % 5 = 0"), k=5).collect()
    cosine = lambda a, b: float(np.dot(a / np.abs(a).max(), b / np.abs(b).max()) / np.linalg.norm(a / np.abs(a).max()) / np.linalg.norm(b / np.abs(b).max()))
    vectors_of = {}
    for k, v in rows:
        vectors_of.setdefault(k, []).append(np.array(v))
    for q in range(0, 60, 5):
        best = {o: max(cosine(a, b) for a in vectors_of[q] for b in vectors_of[o]) for o in vectors_of if o != q}
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[1] for r in mine] == sorted(best, key=lambda o: (-best[o], o))[:5]
        assert all(abs(score - best[o]) < 1e-9 for _, o, score in mine)


def test_a_bucket_takes_few_bytes_a_signature():
    import tracemalloc

    rng = np.random.default_rng(3)
    n, pieces = 40_000, 10
    held = [(rng.integers(0, 1 << 32, n, np.uint32), rng.integers(0, 200, n).astype(np.uint8), rng.integers(0, 500, n).astype(np.uint16), rng.integers(0, 1 << 60, 500).astype(np.uint64)) for _ in range(pieces)]
    for k, piece in enumerate(held):  # one signature that every piece has, of a vertex of its own
        piece[0][7], piece[1][7], piece[2][7] = 5, 255, k
    tracemalloc.start()
    found = jaccard._grouped(held).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * n * pieces  # 62 before: whole vertices, their order and copies of both
    mine = sorted(int(p[3][p[2][7]]) for p in held)
    assert sorted(int(v) for v in np.frombuffer([r for r in found if r["kind"] == 1][0]["members"], np.uint64)) == mine
    assert {v for r in found if r["kind"] == 0 for v in (r["a"], r["b"])} == set(mine)
