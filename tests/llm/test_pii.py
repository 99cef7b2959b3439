import hashlib
import random
import re
import time

import pytest

from gutterline.llm import pii


def by_patterns(text):
    """The base spans by the plain patterns."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_are_the_patterns():
    rnd = random.Random(3)
    for _ in range(20_000):
        text = "".join(rnd.choice("ab.@@-+1 2.3 (4)%") for _ in range(rnd.randint(0, 90)))
        assert pii.find(text) == by_patterns(text), text


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("to john.doe [at] mail [dot] example [dot] com now", "john.doe [at] mail [dot] example [dot] com"),
        ("jane at example dot com", "jane at example dot com"),
        ("ask jane dot doe at example dot org", "jane dot doe at example dot org"),
        ("x at firma dot se please", "x at firma dot se"),
        ("jоhn@exаmple.com", "jоhn@exаmple.com"),
        ("joe＠mail．org", "joe＠mail．org"),
        ("plus one five five five one two three four five six seven", None),
        ("４１１１ １１１１ １１１１ １１１１", None),
        ("one nine two dot one six eight dot one dot one", None),
        ("192[.]168[.]1[.]1", None),
    ],
)
def test_disguises(text, found):
    base, more = pii.spans(text)
    assert [text[a:b] for a, _, b in more] == [found or text]


@pytest.mark.parametrize("text", ["he was at the dot. Com", "one two of three", "at a point in time", "look at the dot in the middle", "pay at the dot matrix", "pay at the door", "the one six men", "Meet at noon, then dot the i"])
def test_clean_texts(text):
    assert pii.spans(text) == ([], [])


def test_masking_keeps_the_rest(make):
    docs = make((1, "mail a.b@c.de or +1 (555) 123-4567 now"), (2, None), (3, "clean"))
    rows = {r.doc_id: r for r in pii.mask_documents(docs).collect()}
    assert rows[1].text == "mail <EMAIL> or <PHONE> now" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None and rows[3].text == "clean" and pii.mask_documents(docs).columns == docs.columns


def test_digest_and_offsets(make):
    text = "é 10.0.0.1 x@y.zz"
    row = pii.detect(make((1, text))).first()
    assert row.spans == "ip:2:10,email:11:17" and row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.n_added) == (1, 1, 0, 0, 0)


def test_odd_documents(odd, make):
    rows = pii.detect(odd).collect()
    assert len(rows) == 13 and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    assert pii.detect(make().where("false")).count() == 0


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "a.b" * 70_000 + "@", " " * 200_000 + "[", "1." * 100_000, "+1" + "(" * 100_000, "one " * 30_000, "x at " * 30_000 + "dot"])
def test_long_runs_take_linear_time(text):
    began = time.monotonic()
    pii.spans(text)
    assert time.monotonic() - began < 10


@pytest.mark.parametrize("trigger", ["write to a@b.com", "ask jo at", "jo dot", "see [", "one two", "1 dot 2", "plus", "jo at x dot com"])
def test_runs_behind_each_trigger_take_linear_time(trigger):
    for run in (" ", "\t", ".", "1", "-", "a ", "dot ", " at ", "@", "one ", "( "):
        long = run * (200_000 // len(run))
        for text in (f"{trigger} {long}x", f"{trigger}{long}", f"{long}{trigger} x"):
            began = time.monotonic()
            pii.spans(text)
            assert time.monotonic() - began < 5, (trigger, run)


@pytest.mark.parametrize("run", [" ", "\t", ".", "1"])
def test_two_million_of_a_kind(run):
    began = time.monotonic()
    for trigger in ("a@b.com", "dot", "at"):
        pii.spans(f"to {trigger} now{run * 2_000_000}x")
    assert time.monotonic() - began < 30


@pytest.mark.parametrize("local", ["ab dot " * 20 + "zz", "x" * 300, "a.b" * 50 + " dot " + "y" * 90])
def test_long_local_parts_are_whole(local):
    base, more = pii.spans(f"to {local} at example dot org now")
    assert base == [] and more == [(3, 0, 3 + len(local) + len(" at example dot org"))]


@pytest.mark.parametrize(("piece", "added"), [("jo [at] mail [dot] com, plain a.b@c.de; ", 1), ("jane dot doe at example dot org and ", 1), ("one nine two dot one six eight dot one dot one; ", 1), ("call 4111 1111 1111 1111 or jo@x\u0430.de. ", 1)])
def test_many_matches_take_linear_time(make, piece, added):
    text = piece * (2_000_000 // len(piece))
    began = time.monotonic()
    base, more = pii.spans(text)
    assert time.monotonic() - began < 20 and len(more) == added * (2_000_000 // len(piece))
    masked = pii.mask_documents(make((1, piece * 2), (2, text))).orderBy("doc_id").collect()
    assert masked[1].text == masked[0].text[: len(masked[0].text) // 2] * (2_000_000 // len(piece))


def test_rewriting_keeps_the_spans():
    """Against a rewriting character by character."""
    rnd = random.Random(9)
    for _ in range(500):
        text = "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 30)))
        cuts = sorted(rnd.sample(range(len(text) + 1), min(len(text) + 1, 6)) * 1)
        edits = [(a, b, rnd.choice(["", "X", "YZ"])) for a, b in zip(cuts[::2], cuts[1::2], strict=False) if a < b]
        out, expected = pii.Rewritten(text), []
        out.rewrite(edits)
        at = 0
        for a, b, new in [*edits, (len(text), len(text), "")]:
            expected += [(text[i], i, i + 1, False) for i in range(at, a)] + [(c, a, b, True) for c in new]
            at = b
        assert list(zip(out.text, out.start.tolist(), out.end.tolist(), out.changed.tolist(), strict=True)) == expected
