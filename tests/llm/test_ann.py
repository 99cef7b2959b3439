import numpy as np
import pytest

from gutterline.llm import ann


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "y", "z") for i, v in vectors], "vec_id long, embedding array<float>, label int, list string, block string, v string")


def exact(vectors, k=20, every=20):
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], np.float32).astype(np.float64)
    out = {}
    for i, q in zip(ids.tolist(), x, strict=True):
        if i % every == 0:
            others = ids != i
            scores = (x[others] * q).sum(1)
            order = np.lexsort((ids[others], -scores))[:k]
            out[i] = list(zip(ids[others][order].tolist(), scores[order].tolist(), strict=True))
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    vectors = list(enumerate(rng.normal(size=(3000, 24)).astype(np.float32).tolist()))
    truth, found = exact(vectors), {}
    for r in ann.neighbours(table(spark, vectors)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(truth)
    x = np.array([v for _, v in vectors], np.float64)
    for q, rows in found.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21)) and all(abs(s - x[q] @ x[i]) < 1e-9 for _, i, s in rows) and all(i != q for _, i, _ in rows)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
    assert np.mean([len({i for _, i, _ in found[q]} & {i for i, _ in truth[q]}) / 20 for q in truth]) >= 0.9


def test_ties_go_to_smaller_ids(spark):
    vectors = [(i, [1.0, 0.0]) for i in range(100)] + [(100 + i, [0.0, 1.0]) for i in range(5)]
    rows = [r for r in ann.neighbours(table(spark, vectors)).collect() if r.query_id == 20]
    assert [r.vec_id for r in sorted(rows, key=lambda r: r.rank)] == list(range(20))


def test_unusable_vectors_take_no_part(spark):
    vectors = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [2.0, 1.0]), (20, [0.5, 0.5]), (40, [0.0, 0.0]), (60, []), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0])]
    rows = ann.neighbours(table(spark, [*vectors, (80, [1.0, 1.0, 1.0]), (100, [9.0])])).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in rows} == {(0, 1, 6), (0, 2, 20), (20, 1, 0), (20, 2, 6), (80, 1, 7)}
    assert ann.neighbours(table(spark, [(0, None)])).count() == 0
    assert ann.neighbours(table(spark, [(0, [1.0])])).count() == 0


def against_all(spark, ids, x, kind="float", k=20):
    """Mean and least recall, by score; each query row checked on its own."""
    rows = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], f"vec_id long, embedding array<{kind}>")
    found = {}
    for r in sorted(ann.neighbours(rows, k).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x, shares = np.asarray(x, np.float32 if kind == "float" else np.float64).astype(np.float64), []
    for q in sorted({int(i) for i in ids if i % 20 == 0}):
        same, wanted = np.flatnonzero(np.asarray(ids) == q), []
        for row in same:
            scores = (x * x[row]).sum(1)
            scores[row] = -np.inf
            wanted.append(np.sort(scores)[::-1][: min(k, len(x) - 1)])
        got = sorted(s for _, _, s in found[q])[::-1]
        assert len(got) == sum(map(len, wanted))
        least = min(w[-1] for w in wanted) - 1e-9
        shares.append(sum(s >= least for s in got) / len(got) if len(same) > 1 else sum(s >= wanted[0][-1] - 1e-9 for s in got) / len(got))
        assert len(same) > 1 or [r for r, _, _ in found[q]] == list(range(1, len(got) + 1))
    return np.mean(shares), min(shares)


@pytest.mark.parametrize("kind", ["gaussian", "clustered", "skewed"])
def test_recall_on_other_shapes(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "gaussian":
        x = rng.normal(size=(3000, 24))
    elif kind == "clustered":
        x = rng.normal(size=(60, 24))[rng.integers(0, 60, 3000)] + 0.1 * rng.normal(size=(3000, 24))
    else:  # a large cloud and small groups far off
        x = np.concatenate([rng.normal(size=(2700, 24)) * 0.3 + 2, np.repeat(rng.normal(size=(60, 24)) * 5, 5, axis=0) + 0.05 * rng.normal(size=(300, 24))])
    order = rng.permutation(len(x))
    mean, least = against_all(spark, np.arange(len(x)), x[order])
    assert mean >= 0.9 and least >= 0.5


def test_repeated_ids_are_candidates_and_queries(spark):
    rows = [(1, [2.0, 0.0]), (1, [3.0, 0.0]), (20, [1.0, 0.0]), (40, [1.0, 1.0]), (40, [0.0, 2.0])]
    out = ann.neighbours(table(spark, rows)).collect()
    assert [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank) if r.query_id == 20] == [(1, 3.0), (1, 2.0), (40, 1.0), (40, 0.0)]
    assert sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == 40) == sorted([(1, 1, 3.0), (2, 1, 2.0), (3, 40, 2.0), (4, 20, 1.0), (1, 40, 2.0), (2, 1, 0.0), (3, 1, 0.0), (4, 20, 0.0)])
    rng = np.random.default_rng(6)
    mean, _ = against_all(spark, np.arange(1500) // 3, rng.normal(size=(1500, 8)))
    assert mean >= 0.9


def test_doubles_are_measured_as_doubles(spark):
    rows = spark.createDataFrame([(0, [1 / 3, 0.0]), (1, [1.0, 1e-12])], "vec_id long, embedding array<double>")
    assert [r.score for r in ann.neighbours(rows).collect()] == [1 / 3]


def test_many_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "OF_ROOT", 6.0)
    monkeypatch.setattr(ann, "PER_LIST", 4)
    mean, _ = against_all(spark, np.arange(3000), np.random.default_rng(7).normal(size=(3000, 16)))
    assert mean >= 0.9


@pytest.mark.parametrize("size", [1e-300, 1e30, 1e150])
def test_doubles_of_any_size(spark, size):
    """Beyond floats the quantiser sees vectors over a power of two."""
    x = np.random.default_rng(8).normal(size=(2000, 16))
    rows = [(i, (v * size).tolist()) for i, v in enumerate(x)]
    found = {}
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    best = {i: set([j for j in np.argsort(-(x @ x[i])).tolist() if j != i][:20]) for i in range(0, 2000, 20)}
    assert set(found) == set(best) and all(len(f) == 20 for f in found.values())
    if size > 1e-150:  # below, all products are 0 and ties go to smaller ids
        assert np.mean([len(found[i] & best[i]) / 20 for i in best]) >= 0.9


def test_vectors_that_only_doubles_tell_apart(spark):
    x = 1 + 1e-9 * np.random.default_rng(9).normal(size=(3000, 16))
    mean, _ = against_all(spark, np.arange(3000), x, "double")
    assert mean >= 0.9
