"""Centroid clustering, repeated passages and whitening against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

RNG = np.random.default_rng(21)


# ------------------------------------------------------------------ operator 12


def letters(n, rng=RNG):
    return bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()


def brute_removal(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passage_texts():
    shared = [letters(n) for n in (199, 200, 201, 230, 700)]
    texts = [None, "", "short", letters(199), letters(200)]
    for p in shared:
        texts += [letters(int(RNG.integers(0, 90))) + p + letters(int(RNG.integers(0, 90))) for _ in range(3)]
    base = letters(1500)
    for k in range(6):   # near copies: one byte differs
        at = 200 * k + 50
        texts.append(base[:at] + "#" + base[at + 1 :])
    texts += [letters(800)] * 3                                    # exact copies
    once = letters(300)
    texts.append(once + letters(40) + once)                        # twice in one text
    texts += ["a" * 900, "a" * 200, "ab" * 450, "abc" * 300]       # overlaps with itself
    texts += ["é" * 150 + letters(30), "x" + "é" * 150]            # repeats cut characters
    crowd = letters(240)                                           # one passage in many texts
    texts += [letters(int(RNG.integers(60, 90))) + crowd + letters(int(RNG.integers(60, 90))) for _ in range(40)]
    return texts


@pytest.mark.parametrize("group", [256, 3])
def test_repeats_match_brute_force(make, monkeypatch, group):
    """A small GROUP sends crowded anchors through the finer cuts, down to windows."""
    from rugosa.llm import repeated_bytes

    monkeypatch.setattr(repeated_bytes, "GROUP", group)
    texts = passage_texts()
    ids = [None if i == 7 else 5 if i in (8, 9) else i for i in range(len(texts))]
    rows = repeated_bytes.digest(make(list(zip(ids, texts, strict=True)))).collect()
    got = sorted([tuple(r) for r in rows], key=str)
    want = sorted([(i, *b) for i, b in zip(ids, brute_removal(texts), strict=True)], key=str)
    assert got == want


def test_repeats_keep_spans_and_bytes(make):
    from rugosa.llm.repeated_bytes import remove_repeats

    p = letters(260)
    rows = {r["doc_id"]: r for r in remove_repeats(make([(1, "AAA" + p + "BBB"), (2, p), (3, "alone")])).collect()}
    assert [(s["start"], s["end"]) for s in rows[1]["spans"]] == [(3, 263)]
    assert bytes(rows[1]["kept"]) == b"AAABBB" and bytes(rows[2]["kept"]) == b"" and bytes(rows[3]["kept"]) == b"alone"


def test_repeats_of_an_empty_table(make):
    from rugosa.llm.repeated_bytes import digest

    out = digest(make([(1, "x")]).where("doc_id < 0"))
    assert out.collect() == [] and out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_long_text_is_cut_into_blocks(make, monkeypatch):
    from rugosa.llm import repeated_bytes

    monkeypatch.setattr(repeated_bytes, "BLOCK", 2048)
    monkeypatch.setattr(repeated_bytes, "_LOW", np.uint64(2047))
    p = letters(500)
    texts = [letters(1900) + p + letters(3000), letters(4000) + p, letters(9000)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    starts = Counter()
    for begin, end, parts in repeated_bytes._blocks(offsets):
        assert end - begin <= 2048
        for row, a, b in parts:
            assert offsets[row] <= a < b <= offsets[row + 1]
            starts.update(range(a, b - 199))
    assert set(starts.values()) == {1}   # every window once
    assert sum(starts.values()) == sum(len(t) - 199 for t in texts)
    hashes = repeated_bytes._Hashes()
    begin, end, parts = next(iter(repeated_bytes._blocks(offsets)))
    rows, a, b = (np.array(x) for x in zip(*parts, strict=True))
    of, at, lo, hi, h, f = repeated_bytes.fragments(hashes, data[begin:end], a - begin, b - begin)
    assert (hi - lo + 1).sum() == sum(y - x - 199 for x, y in zip(a, b, strict=True))
    assert (lo >= 0).all() and (hi <= 200 - repeated_bytes.ANCHOR).all()


def test_collection_transform_is_the_sorted_order():
    from rugosa.llm.repeated_bytes import collection_transform

    rng = np.random.default_rng(5)
    for _ in range(25):
        strings = [rng.integers(1, 4, rng.integers(1, 14)) for _ in range(rng.integers(1, 9))]
        order = sorted((tuple(s[len(s) - j :].tolist()) + (0,), i, j) for i, s in enumerate(strings) for j in range(len(s) + 1))
        order.sort(key=lambda t: (t[0], t[1]))
        bwt, lcp = collection_transform(strings, 4)
        assert bwt.tolist() == [int(strings[i][len(strings[i]) - j - 1]) if j < len(strings[i]) else 0 for _, i, j in order]
        shared = [0]
        for (a, _, _), (b, _, _) in zip(order, order[1:], strict=False):
            n = next((k for k, (x, y) in enumerate(zip(a[:-1], b[:-1], strict=False)) if x != y), min(len(a), len(b)) - 1)
            shared.append(min(n, 4))
        assert lcp.tolist() == shared


# ------------------------------------------------------------------ operators 11 and 13


@pytest.fixture(scope="module")
def vectors(spark):
    """(vec_id, vector) rows as a table whose other columns clash."""

    def build(rows, kind="array<float>"):
        df = spark.createDataFrame([(i, v, 0) for i, v in rows], f"vec_id long, embedding {kind}, label int")
        for name in ("x", "cluster", "n", "component", "sums", "distance", "r"):
            df = df.selectExpr("*", f"'c' as `{name}`")
        return df

    return build


def vector_rows(n=160, size=64):
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.normal(i % 5, 0.4, size).astype(np.float32)]) for i in range(n)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (5, rows[4][1]), (None, rows[6][1]), (None, rows[7][1])]
    return rows


ODD = [(900, None), (901, []), (902, [0.5] * 63 + [None]), (903, [0.5] * 63 + [float("nan")]), (904, [float("inf")] + [0.1] * 63), (905, [0.5] * 63)]


def brute_clusters(rows, count=40, rounds=5):
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    named = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for (i, _), v in zip(rows, x, strict=True))
    cent = [v for _, v in named[:count]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cent)) for v in x]

    for _ in range(rounds):
        at = assign()
        for k in range(len(cent)):
            own = [v for v, (_, c) in zip(x, at, strict=True) if c == k]
            if own:
                cent[k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = assign()
    by = Counter()
    for d, c in at:
        by[c] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return [(i, c, d, by[c], sum(by.values()), name[c]) for (i, _), (d, c) in zip(rows, at, strict=True)]


def test_clusters_match_brute_force(vectors):
    from rugosa.llm.centroid_clustering import cluster

    rows = vector_rows()
    got = sorted([tuple(r) for r in cluster(vectors(rows + ODD)).collect()], key=str)
    assert got == sorted(brute_clusters(rows), key=str)


def test_few_equal_and_no_vectors(vectors):
    from rugosa.llm.centroid_clustering import cluster

    few = [(1, [0.25] * 64), (2, [0.25] * 64), (3, [-0.25] * 64)]
    got = sorted([tuple(r) for r in cluster(vectors(few)).collect()])
    assert got == sorted(brute_clusters(few))
    empty = cluster(vectors(ODD))
    assert empty.collect() == [] and empty.columns[:3] == ["vec_id", "cluster", "distance"]


def test_search_rejects_and_stays_exact():
    from rugosa.llm.centroid_clustering import Centroids

    rng = np.random.default_rng(1)
    for size in (3, 100, 10**9):
        c = rng.integers(-size, size + 1, (40, 16)) + rng.integers(-5 * size, 5 * size, (40, 1))
        c[39], c[7] = c[0], c[1]
        x = np.vstack([c[rng.integers(0, 40, 200)] + rng.integers(-size // 3, size // 3 + 1, (200, 16)), c[:3]])
        number, best, computed = Centroids(c.tolist()).nearest(x)
        d = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
        assert number.tolist() == [min(range(40), key=lambda k: (r[k], k)) for r in d]
        assert [int(b) for b in best] == [int(r[k]) for r, k in zip(d, number, strict=True)]
        if size > 3:
            assert computed < 0.5 * d.size


def brute_whitening(rows):
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows])
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    a = u - s / n
    e, q = np.linalg.eigh(a.T @ a / n)
    return x, n, s, e[::-1], q[:, ::-1]


def test_whitening_matches_eigenvectors(vectors):
    from rugosa.llm.whitening import whiten

    rows = vector_rows(size=24)
    odd = [(i, v if v is None else v[:24] if len(v) == 64 and None in v[:24] else None) for i, v in ODD] + [(906, [1.0] * 23), (907, [float("nan")] * 24)]
    got = [tuple(r) for r in whiten(vectors(rows + odd)).collect()]
    x, n, s, e, q = brute_whitening(rows)
    assert len(got) == 4 * len(rows) and {r[2] for r in got} == {n}
    w = (x - s / n) @ q[:, :4] / np.sqrt(e[:4])
    by = {}
    for r in got:
        by.setdefault((r[0], r[3]), {}).setdefault(r[1], r)
    sign = None
    for (i, _), v, z in zip(rows, x, w, strict=True):
        dev = sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True))
        own = by[i, dev]
        z4 = np.array([own[k][4] for k in range(1, 5)])
        if sign is None:
            sign = np.sign(z4 * z)
        assert np.allclose(z4 * sign, z, atol=1e-9)
        assert np.allclose([own[k][5] for k in range(1, 5)], e[:4] / e.sum(), rtol=1e-10)
        assert all(own[k][6] < 1e-9 for k in range(1, 5))


def test_whitening_without_variance(vectors):
    from rugosa.llm.whitening import whiten

    assert whiten(vectors([(1, [0.5] * 4), (2, [0.5] * 4)])).collect() == []
    assert whiten(vectors(ODD[:2])).collect() == []
    one = [tuple(r) for r in whiten(vectors([(1, [0.0, 1.0]), (2, [0.0, 3.0]), (2, [0.0, 3.0]), (3, [0.0, 5.0])])).collect()]
    assert len(one) == 4 and {r[1] for r in one} == {1} and {r[2] for r in one} == {3}
    assert all(abs(r[5] - 1) < 1e-12 and r[6] < 1e-12 for r in one)


def test_singular_values_and_directions():
    from rugosa.llm.whitening import bidiagonalise, dqds, leading_directions, triangle

    rng = np.random.default_rng(4)
    for t in range(60):
        d = int(rng.integers(1, 40))
        a = rng.standard_normal((int(rng.integers(1, 90)), d)) * (np.exp(rng.uniform(-6, 6, d)) if t % 3 == 0 else 1)
        if t % 4 == 0 and d > 3:
            a[:, 1], a[:, 2] = a[:, 0], 0
        r = triangle(a)
        b, c, _ = bidiagonalise(r)
        want = np.zeros(d)
        s = np.linalg.svd(a, compute_uv=False)
        want[: len(s)] = s
        assert np.allclose(dqds(b, c), want, atol=1e-12 * s[0], rtol=1e-11)
        values, vectors = leading_directions(r, min(4, d))
        live = values > 1e-6 * values[0]
        v = vectors[:, live]
        assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-11)
        assert np.allclose(a.T @ (a @ v), v * values[live] ** 2, atol=1e-11 * s[0] ** 2)
    # equal and nearly equal values
    for s in (np.ones(12), 1 + 1e-9 * np.arange(12)):
        q1, q2 = (np.linalg.qr(rng.standard_normal((12, 12)))[0] for _ in range(2))
        values, vectors = leading_directions(triangle((q1 * s) @ q2), 4)
        assert np.allclose(values, np.sort(s)[::-1][:4], atol=1e-13)
        assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)


def test_graded_values_keep_their_own_digits():
    """Each value of a graded bidiagonal is right to its own last places, where
    squares in a covariance would have lost the small ones."""
    from fractions import Fraction

    from rugosa.llm.whitening import dqds

    b, c = 10.0 ** -np.arange(0, 24, 4.0), 0.3 * 10.0 ** -np.arange(0, 20, 4.0)
    got = dqds(b, c)
    # the product of all values is the determinant, the sum of squares the trace
    assert math.isclose(math.prod(got), math.prod(b), rel_tol=1e-13)
    trace = sum(Fraction(v) ** 2 for v in [*b, *c])
    assert math.isclose(sum(v * v for v in got), float(trace), rel_tol=1e-14)
    # the least one from the inverse, whose largest value it is
    full = np.diag(b) + np.diag(c, 1)
    inv = np.linalg.solve(full, np.eye(6))
    assert math.isclose(got[-1], 1 / np.linalg.svd(inv, compute_uv=False)[0], rel_tol=1e-12)
