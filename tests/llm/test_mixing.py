import glob
import os
from fractions import Fraction

import pytest

from gutterline.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, k0 string, size string, within string"


def documents(spark, *rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def plain_targets(sizes, share=Fraction(3, 2), most=2):
    """Resharing by hand, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    left, active, out = share * sum(sizes.values()), set(order), {}
    while active:
        unit = Fraction(left) / sum(weight[s] for s in active)
        above = {s for s in active if weight[s] * unit > most * sizes[s]}
        if not above:
            return out | {s: weight[s] * unit for s in active}
        for s in above:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        active -= above
    return out


def test_same_rows_as_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name, sql in queries.oracle_sql().items():
        for path in glob.glob(f"{sf}/*.parquet"):
            source = f"{path}/*.parquet" if os.path.isdir(path) else path
            connection.sql(f"create or replace view {os.path.basename(path).removesuffix('.parquet')} as select * from '{source}'")
        ours, theirs = queries.queries()[name](spark, sf), connection.sql(sql)
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        assert sorted(map(tuple, ours.select(*columns).collect())) == sorted(theirs.project(", ".join(columns)).fetchall())


def test_words(spark):
    texts = ["a b\tc", "", None, " \n", "x y z", "one", "\x0bv\x0cw\x1f"]
    assert [r[0] for r in documents(spark, *((n, t, "s") for n, t in enumerate(texts))).orderBy("doc_id").select(mixing.size_of(mixing.F.col("text"))).collect()] == [3, 0, 0, 0, 2, 1, 2]


def test_targets_and_budgets(spark):
    """A large source, a null one, an empty name, one without words, one document alone."""
    rows = [(n, "w " * (1 + n % 7), "big") for n in range(600)] + [(1000 + n, "w " * 30, None) for n in range(5)] + [(2000 + n, "w w w", "") for n in range(40)]
    rows += [(3000, None, "none"), (3001, "", "none"), (4000, "long " * 5000, "one"), (None, "no id", "big"), (None, None, "big")]
    got = mixing.mixed(documents(spark, *rows)).collect()
    again = mixing.mixed(documents(spark, *reversed(rows))).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    place = {(r.doc_id, r.size): r for r in got}
    sizes, taken, goal = {}, {}, {}
    for doc_id, text, source in rows:
        row = place[doc_id, len((text or "").split())]
        sizes[source] = sizes.get(source, 0) + row.size
        taken[source] = taken.get(source, 0) + row.taken
        goal[source] = row.target
        assert 0 <= row.taken <= 2 * row.size
    expected = plain_targets(sizes)
    assert all(goal[s] == pytest.approx(float(expected[s]), rel=1e-12) and abs(taken[s] - goal[s]) <= 1 for s in sizes)
    assert {place[d, len((t or "").split())].source_size == sizes[s] for d, t, s in rows} == {True}


def test_larger_budgets_take_more(spark):
    rows = documents(spark, *((n, "w " * (1 + n % 13), f"s{n % 3}") for n in range(300)))
    few, many = ({r.doc_id: r.taken for r in mixing.mixed(rows, weights=(1,), share=Fraction(k, 10)).collect()} for k in (3, 7))
    assert all(few[k] <= many[k] for k in few) and sum(few.values()) < sum(many.values())
    assert {r.taken == 2 * r.size for r in mixing.mixed(rows, share=Fraction(5)).collect()} == {True}


def test_one_id_and_equal_rows(spark):
    """Rows of one id, and equal rows: the budget is met all the same."""
    rows = [(7, f"text {n} {'w ' * (n % 5)}", "a") for n in range(200)] + [(8, "same text here", "b")] * 150 + [(9, "w", "c")] * 3000
    got = mixing.mixed(documents(spark, *rows)).collect()
    for size in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1


def test_odd_documents(odd, make, spark):
    got = mixing.mixed(odd).collect()
    assert len(got) == 13 and abs(sum(r.taken for r in got) - got[0].target) <= 1
    assert mixing.mixed(make().where("false")).count() == 0 and mixing.mixture(make().where("false")).count() == 0
    assert {(r.size, r.taken, r.target) for r in mixing.mixed(documents(spark, (1, None, "a"), (2, " ", None))).collect()} == {(0, 0, 0.0)}


def test_mixture_has_the_words(spark):
    rows = documents(spark, *((n, " ".join(f"w{n}x{k}" for k in range(1 + n % 13)), f"s{n % 4}") for n in range(200)), (900, None, "s1"))
    taken = {r.doc_id: r.taken for r in mixing.mixed(rows).collect() if r.taken}
    texts, mix = {r.doc_id: r.text for r in rows.collect()}, mixing.mixture(rows)
    got = {}
    for r in mix.collect():
        assert (texts[r.doc_id] + " ").startswith(r.text + " ") and r.k0 == "x"
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert mix.columns == rows.columns and got == taken
