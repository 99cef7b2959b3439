import random
import textwrap

import pytest

from gutterline.llm import licenses


def test_exact_and_changed_wordings(make):
    docs = make(
        (1, "Some text.\nReleased under the MIT License.\nMore."), (2, "Released under the MIT-License , kindly."), (3, "Licensed under CC BY-NC 4.0."), (4, "Licensed under CC BY 4.0."), (5, "copyright is a word here"),
        (6, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
        (7, "filler " * 3000 + "All rights reserved. " + "filler " * 3000),
    )
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert {k: r.licenses for k, r in rows.items()} == {1: "MIT", 2: "", 3: "CC-BY-NC-4.0", 4: "CC-BY-4.0", 5: "", 6: "AGPL-3.0", 7: "proprietary"}
    match = rows[1].matches[0]
    assert (match.start, match.end, match.differing) == (11, 41, 0) and match.saved > 0.4


def test_notices_in_a_row_and_in_one_line(make):
    row = licenses.scan(make((1, "Released under the MIT License.\nAll rights reserved.\nLicensed under CC BY 4.0."), (2, "Intro. Licensed under CC BY 4.0. Then \u0130 more. RELEASED UNDER THE MIT LICENSE. End"), (3, "All rights reserved. " * 500))).collect()
    assert [[m.license for m in r.matches] for r in row[:2]] == [["MIT", "proprietary", "CC-BY-4.0"], ["CC-BY-4.0", "MIT"]]
    spans = [(m.start, m.end) for m in row[2].matches]
    assert spans == [(21 * i, 21 * i + 19) for i in range(500)]


def test_odd_documents(odd):
    rows = licenses.scan(odd).collect()
    assert len(rows) == 13 and all(r.licenses == "" and r.n_candidates == 0 for r in rows)


def test_empty_table(make):
    assert licenses.scan(make().where("false")).count() == 0


def test_short_notice_in_a_long_line():
    prose = "the software and its copies are subject to conditions that the author may use modify publish and distribute for any person without warranty of any kind and the work is "
    for notice, name in (("All rights reserved.", "proprietary"), ("Released under the MIT License.", "MIT"), ("Licensed under CC BY 4.0.", "CC-BY-4.0")):
        for text in (prose * 4 + notice, notice + " " + prose * 3, prose * 2 + notice + " " + prose * 2):
            assert [m[0] for m in licenses.matches(text)] == [name]


def cased(text, width, prefix):
    return "\n".join(prefix + line for line in textwrap.wrap(text, width, break_on_hyphens=False))


@pytest.mark.parametrize("width", [60, 72, 100])
@pytest.mark.parametrize("prefix", ["", "# ", "// ", " * "])
def test_wrapped_notices(width, prefix):
    prose = "A plain first paragraph about the history of gardens.\nIt has two lines.\n\n"
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            notice = cased(text, width, prefix)
            around = f"{prose}{notice}\n\nAnd a last paragraph, on the same theme."
            found = licenses.matches(around)
            assert [m[0] for m in found] == [name], (text, found)
            _, start, end, differing, saved = found[0]
            assert differing == 0 and saved > 0.2
            first, last = licenses.words_of(text)[0], licenses.words_of(text)[-1]
            assert around[start:].lower().startswith(first) and around[:end].lower().endswith(last) and len(prose) <= start and end <= len(prose) + len(notice)


def test_paragraphs_of_one_notice_are_one():
    text = "\n\n".join(textwrap.fill(p, 72, break_on_hyphens=False) for p in (licenses._MIT, licenses._AS_IS))
    assert [(m[0], m[3]) for m in licenses.matches(f"Copyright (c) 2001 Somebody\n\n{text}\n")] == [("MIT", 0)]
    text = "\n\n".join(textwrap.fill(p, 80, break_on_hyphens=False) for p in (licenses._BSD, licenses._BSD_THIRD, licenses._BSD_AS_IS))
    assert [m[0] for m in licenses.matches(text)] == ["BSD-3-Clause"]


@pytest.mark.parametrize(
    "text",
    [
        "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY 3.0.", "This work is licensed under the GNU General Public License, version 1.", "Licensed under CC BY-ND 4.0.", "Licensed under the Mozilla Public License, v. 1.1.",
        "Released under the XYZ License.",
    ],
)
def test_words_that_tell_licences_apart_are_exact(text):
    assert licenses.matches(text) == []


def every_window(text):
    """Names of licences whose words stand in the text in a row, by comparing
    each template with each window of words."""
    words = licenses.words_of(text)
    return {name for name, texts in licenses.TEMPLATES.items() for t in map(licenses.words_of, texts) if any(words[i : i + len(t)] == t for i in range(len(words) - len(t) + 1))}


def test_exact_wordings_against_every_window():
    rng, all_texts = random.Random(8), [(n, t) for n, ts in licenses.TEMPLATES.items() for t in ts]
    filler = ["the garden path was long", "licensed plumbers work here", "a copy of the map", "under the terms we met", "free of charge for you", "permission slips and notices", "with or without sugar"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 3)):
            parts += rng.choices(filler, k=rng.randint(0, 40)) + [rng.choice(all_texts)[1]]
        text = rng.choice([" ", "\n", ". "]).join([*parts, *rng.choices(filler, k=5)])
        found = {m[0] for m in licenses.matches(text)}
        # a wording inside another one is told by the larger
        inside = {n for n in every_window(text) - found if any(n2 in found and any(set(every_window(t2)) & {n} for t2 in licenses.TEMPLATES[n2]) for n2 in found)}
        assert found <= every_window(text) and every_window(text) - inside == found, (text, found)


def test_changed_words_are_counted():
    words = licenses._MIT.split()
    words[10] = "anything"
    del words[20]
    (match,) = licenses.matches("Intro words here. " + " ".join(words) + " More words after it, of the same kind and with the same small words.")
    assert match[0] == "MIT" and 2 <= match[3] <= 3
