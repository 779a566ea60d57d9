"""Pages whose elements say nothing about what they are, and decoding against all subsets."""

import itertools

import numpy as np
import pytest

from cellarium.llm import html_extraction as H
from cellarium.llm.dom import Node

ONE = "The council decided on Monday to open the old bridge again after eleven months of repairs, and it cost less than planned."
TWO = "A second survey is due in two years, when engineers will look at the piers below the water line with divers."
MENU = '<a href="/n">News</a> <a href="/s">Sport</a> <a href="/c">Culture</a>'
PLAIN = [
    (f"<html><body><div><div>{MENU}</div><div><h1>Old bridge reopens</h1><p>{ONE}</p><p>{TWO}</p></div><div>© 2023 The Daily</div></div></body></html>", f"Old bridge reopens {ONE} {TWO}"),
    (f"<div>{MENU}</div><div><h1>Old bridge reopens</h1><div>{ONE}</div><div>{TWO}</div></div><div>© 2023 The Daily</div>", f"Old bridge reopens {ONE} {TWO}"),
    (f"<body><div>{MENU}</div><h2>Old bridge reopens</h2><div>{ONE}</div><div>{TWO}</div><div>© 2023</div></body>", f"Old bridge reopens {ONE} {TWO}"),
    (f"<div><div><div>{MENU}</div></div><div><div><div>{ONE}</div></div></div></div>", ONE),
]


@pytest.mark.parametrize("page,want", PLAIN)
def test_densest_prose(page, want):
    nodes, texts = H.parse(page)
    keep = H.densest(nodes)
    assert " ".join(t for i, t in texts if keep[i]) == want


@pytest.mark.parametrize("page,want", PLAIN)
def test_pages_without_names_are_not_empty(page, want):
    got = H.extract([page], H.trained())[0]
    assert ONE in got and "Culture" not in got


@pytest.mark.parametrize("page", ["", f"<div>{MENU}</div>", f"<footer><p>{ONE}</p></footer>", f"<div class='comments'><div><p>{ONE}</p></div></div>", f"<form><p>{ONE}</p></form>", "<div>© 2023 The Daily</div>", f"<p>{' '.join(f'<a href=/x>{w} and more</a>' for w in ONE.split())}</p>"])
def test_nothing_where_there_is_no_prose(page):
    nodes, texts = H.parse(page)
    keep = H.densest(nodes)
    assert not any(keep[i] for i, _ in texts)


@pytest.mark.parametrize("seed", range(6))
def test_decoding_is_the_best_of_all_closed_subsets(seed):
    """Of all sets of nodes that hold the parents of what they hold, decoding keeps one of the largest sum of log-odds."""
    r = np.random.default_rng(seed)
    for _ in range(40):
        n = int(r.integers(1, 10))
        nodes = [Node("#root", -1, 0)]
        for i in range(1, n):
            nodes.append(Node("div", int(r.integers(0, i)), 0))
            nodes[nodes[i].parent].children.append(i)
        margin = np.round(r.normal(size=n) * 2) / 2
        keep = H.decode(nodes, margin)
        best = max(sum(margin[i] for i in range(n) if s[i]) for s in itertools.product((False, True), repeat=n) if s[0] and all(s[nodes[i].parent] for i in range(1, n) if s[i]))
        assert keep[0] and all(keep[nodes[i].parent] for i in range(1, n) if keep[i])
        assert sum(margin[i] for i in range(n) if keep[i]) == pytest.approx(best)
