"""Groups of mutated copies against brute force: families larger than the leaders of a list, links near the threshold."""

import random

import pytest

from quarry.llm import ngram_join


def family_texts(seed: int, k: int, percent: int, families: int = 11, size: int = 20) -> list[str]:
    """Families whose members descend from one another, each by as many changed words as a link allows, so that leaders cover few of them."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    out = []
    for _ in range(families):
        members = [[word() for _ in range(rng.choice((90, 200, 300)))]]
        most = int(len(members[0]) * (100 - percent) / (100 + percent) / k)
        while len(members) < size:
            new = list(members[-1] if rng.random() < 0.8 else rng.choice(members))
            for j in rng.sample(range(len(new)), rng.choice((most, most, max(most - 1, 1)))):
                new[j] = word()
            members.append(new)
        out += [" ".join(m) for m in members]
    rng.shuffle(out)
    return out


def brute_force(rows: list[tuple[int, str]], k: int, percent: int) -> tuple[dict[int, int], set[tuple[int, int]]]:
    """Least reachable id of each row, and all links."""
    own = {}
    for i, t in rows:
        w = t.lower().split()
        own[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    links = {(a, b) for a in own for b in own if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b])}
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in own}, links


@pytest.mark.parametrize("seed,k,percent,partitions", [(1, 3, 90, 1), (2, 3, 90, 9), (3, 5, 80, 1), (4, 5, 80, 9)])
def test_groups_of_mutated_copies(spark, seed, k, percent, partitions):
    rows = list(enumerate(family_texts(seed, k, percent)))
    want, links = brute_force(rows, k, percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    documents, found = ngram_join.ngram_join(docs, k, percent)
    assert {r.doc_id: r.component_id for r in documents.collect()} == want
    assert {(r.a, r.b) for r in found.collect()} <= links


@pytest.mark.parametrize("seed,k,percent,cell", [(5, 3, 90, 1024), (6, 5, 80, 8)])
def test_every_link_between_different_sets(spark, monkeypatch, seed, k, percent, cell):
    """All links, those inside groups too, with lists that fall into many cells; copies are one class."""
    monkeypatch.setattr(ngram_join, "CELL", cell)
    texts = family_texts(seed, k, percent, families=4, size=12)
    rows = list(enumerate(texts + [texts[0], "", "two words"]))
    want, links = brute_force(rows, k, percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    documents, found = ngram_join.ngram_join(docs, k, percent)
    copy = len(texts)
    assert {(r.a, r.b) for r in found.collect()} == {x for x in links if copy not in x}
    assert {r.doc_id: r.component_id for r in documents.collect()} == want
