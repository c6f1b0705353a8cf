"""Links between labels: all of them, and each compared about once."""

import random

import pytest

from granary.operators import dedup


@pytest.mark.parametrize("least, shared", [(0.6, 2), (0.85, 1)])
def test_links_of_sets_of_any_size(spark, least, shared):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    sets = [frozenset(rng.sample(words[: rng.choice((8, 60, 400))], k)) for k in [1, 2, 3, 4, 6, 8] * 12]
    for size in (12, 50, 300):  # 300: more tokens than a sketch has bits
        base = rng.sample(words, size)
        sets += [frozenset(rng.sample(base, size - rng.randint(0, size // 3)) + [f"own{size}x{k}"]) for k in range(25)]
    labels = [(k - 50, "de", " ".join(rng.sample(sorted(s), len(s)))) for k, s in enumerate(sets)]
    members, links = dedup.linked_labels(spark.createDataFrame(labels, "item long, lang string, label string"), least, shared)
    first = {}
    for item, _, label in labels:
        first.setdefault(frozenset(label.split()), item)
    assert {(r["item"], r["set"], r["n"]) for r in members.collect()} == {(i, first[frozenset(t.split())], len(t.split())) for i, _, t in labels}
    want = {(i, j, len(s & t)) for s, i in first.items() for t, j in first.items() if i < j and len(s & t) >= shared and len(s & t) / len(s | t) >= least}
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_near_labels_are_compared_once(spark, monkeypatch):
    """Before, whole sets were joined and compared at each of the rare tokens that they share, 10 or more here."""
    seen, near = [], dedup.near_sets
    monkeypatch.setattr(dedup, "near_sets", lambda *a: seen.append(near(*a)) or seen[-1])
    labels = [(k, "de", " ".join(f"w{j}" if (k * 7 + j * 11) % 40 > 2 else f"own{k}x{j}" for j in range(40))) for k in range(120)]
    links = dedup.linked_labels(spark.createDataFrame(labels, "item long, lang string, label string"))[1].count()
    assert links > 5000 and seen[0].columns == ["a", "b"] and seen[0].count() < 1.5 * links
