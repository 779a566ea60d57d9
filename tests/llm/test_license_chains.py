"""Licenses with long insertions, repeated phrases, and the bound before alignment against alignment without it."""

import random
import time

import pytest

from cellarium.llm import license_scan as L

MIT = L._MIT
BSD = dict(L.TEMPLATES[:4])["BSD-3-Clause"]


@pytest.fixture(scope="module")
def known():
    return L.Templates(L.TEMPLATES, 0.8)


def test_a_sentence_put_in(known):
    at = MIT.index(" ", 500)
    text = "Copyright\n" + MIT[:at] + " This sentence of seventeen words was put into the license by somebody who wanted to say more." + MIT[at:]
    (found,) = known.scan(text)
    assert found["license"] == "MIT" and found["coverage"] == 1 and (found["start"], found["end"]) == (10, len(text) - 1)


def test_a_long_name(known):
    name = "the regents of the very long and wide name of a university of somewhere"
    text = BSD.replace("the copyright holder nor", f"{name} nor").replace("COPYRIGHT HOLDERS AND", f"{name} AND")
    (found,) = known.scan(text)
    assert found["license"] == "BSD-3-Clause" and found["coverage"] > 0.95 and found["end"] - found["start"] > len(BSD)


def test_repeats_are_rows(known):
    found = known.scan(f"{MIT}\n" * 3 + "All rights reserved. All rights reserved.")
    assert [f["license"] for f in found] == ["MIT"] * 3 + ["all-rights-reserved"] * 2 and all(f["coverage"] == 1 for f in found)


@pytest.mark.parametrize("phrase", ["redistribution and use in source and binary forms ", "the gnu general public license "])
def test_repeated_phrases_take_time_in_proportion(known, phrase):
    def took(n):
        began = time.process_time()
        assert known.scan(phrase * (n // len(phrase))) == []
        return time.process_time() - began

    took(1_000)
    assert took(100_000) < 30  # a megabyte in well under a minute; it took ten of them


@pytest.mark.parametrize("seed", range(5))
def test_bound_loses_nothing(seed, monkeypatch):
    """Templates cut, mixed and strewn over texts: with and without the bound on free stretches the same matches."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    templates = tuple((f"t{k}", " ".join(r.choice(words) for _ in range(r.randint(3, 40)))) for k in range(6))
    t = L.Templates(templates, 0.8)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            ws = r.choice(templates)[1].split()
            for _ in range(r.randint(0, len(ws) // 4)):
                ws[r.randrange(len(ws))] = r.choice(words + ["x"])
            if r.random() < 0.4:
                at = r.randint(0, len(ws))
                ws[at:at] = ["y"] * r.randint(1, 6)
            parts += [" ".join(ws), " ".join(r.choice(words) for _ in range(r.randint(0, 8)))]
        texts.append(" ".join(parts))
    bounded = [t.scan(x) for x in texts]
    monkeypatch.setattr(L, "may_reach", lambda *_: True)
    assert [t.scan(x) for x in texts] == bounded and any(bounded)
