import itertools
import random

import numpy as np
import pytest

from gutterline.llm import filter_audit

PROSE = " ".join(f"word{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(60))


def failing(docs):
    """For each document, the filters it fails, by the conditions."""
    out = []
    for doc_id, text, _ in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        bad = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text)}
        bad["E"] = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs)
        out.append({f for f, b in bad.items() if b})
    return out


def by_hand(docs, good, toxic):
    """Each order applied document by document; the sums over all orders."""
    fails, rows, sums = failing(docs), [], {}
    for part in {s or "" for _, _, s in docs}:
        own = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = set(own)
            for step, f in enumerate(order, 1):
                hit = {k for k in own if f in fails[k]}
                out = hit & left
                lost = lambda ids: sum(docs[k][0] in ids for k in out)  # noqa: B023,E731
                rows.append((part, "".join(order), step, len(left - out), len(out), len(hit - left), sum(fails[k] == {f} for k in own), lost(good), lost(toxic)))
                sums[part, f] = sums.get((part, f), 0) + len(out)
                left -= out
    return sorted((*r, sums[r[0], r[1][r[2] - 1]]) for r in rows)


def documents():
    rnd, docs = random.Random(6), []
    for n in range(90):
        text = PROSE if rnd.random() < 0.5 else "few words é"
        text = text + " " + PROSE.split()[0] * 1 if rnd.random() < 0.3 else text
        text = "repeat it " * 40 if rnd.random() < 0.2 else text
        text = text.upper() if rnd.random() < 0.2 else text
        text += rnd.choice(["", "", f" {n}", " # $", " |"])
        docs.append((n if n % 17 else None, rnd.choice([text, text, None, ""]) if n % 5 == 0 else text, [None, "", "a", "b"][n % 4]))
    return docs + [docs[3], docs[3], (500, "日本 " * 60, "c")]


def test_against_each_order(spark):
    docs = documents()
    labels = [(n, n % 3 % 2, int(n % 7 == 0)) for n in range(0, 90, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (6, 2, 2), (9999, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", "y", "z") for d in docs], "doc_id long, text string, source string, mask string, digest string, part string")
    marks = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, bad string")
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    assert sorted(map(tuple, filter_audit.audit(frame, marks).collect())) == by_hand(docs, good, toxic)


def test_masks():
    texts = ["", PROSE, "a " * 100, PROSE.upper(), PROSE + "%", "éA" * 60, "A" + "b" * 19, "Ab\x1fc"]
    assert [filter_audit.failures(t.encode()) for t in texts] == [sum(1 << "ABCD".index(f) for f in x) for x in failing([(0, t, "") for t in texts])]


@pytest.mark.parametrize("players", [1, 3, 5])
def test_potentials_are_shapley_values(players):
    """Against the mean over all orders of any game of removal."""
    counts = np.random.default_rng(players).integers(0, 1000, 1 << players)
    v = filter_audit.removed_by(counts)
    potential, everything = filter_audit.potentials(v), (1 << players) - 1
    for i in range(players):
        total = sum(int(v[before | 1 << i] - v[before]) for order in itertools.permutations(range(players)) for before in [sum(1 << j for j in order[: order.index(i)])])
        assert potential[everything] - potential[everything ^ 1 << i] == total


def test_odd_documents(spark, odd, make):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(odd, labels).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert len(rows) == 5 and rows[0].kept + rows[0].removed == 13 and {r.good_lost for r in rows} == {0}
    assert filter_audit.audit(make().where("false"), labels).count() == 0


def test_filtered_documents(spark):
    docs = [d for d in documents() if d[0] is not None]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, source string, mask string")
    fails = failing(docs)
    for filters in ("ABCDE", "AD", "E"):
        kept = filter_audit.without_failures(frame, filters)
        assert kept.columns == frame.columns
        assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d[0]) for d, f in zip(docs, fails, strict=True) if not f & set(filters))
