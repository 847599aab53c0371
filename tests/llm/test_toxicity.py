"""The label model's parts against brute force."""

from __future__ import annotations

import itertools

import numpy as np
from banlist.llm import toxicity


def _voters(rng, n: int):
    """Labels and votes: 1 follows 0, 2 follows 1, and 3 and 4 are on their own."""
    y = (rng.random(n) < 0.3).astype(int)
    fire = lambda hit, miss: (rng.random(n) < np.where(y == 1, hit, miss)).astype(float)
    first = fire(0.5, 0.05)
    second = np.where(rng.random(n) < 0.9, first, fire(0.3, 0.05))
    third = np.where(rng.random(n) < 0.8, second, fire(0.3, 0.05))
    return y, np.stack([first, second, third, fire(0.4, 0.02), fire(0.3, 0.1)], axis=1)


def test_posteriors_come_from_the_votes_alone():
    y, votes = _voters(np.random.default_rng(3), 4000)
    lies = np.random.default_rng(4).random(4000) < 0.02
    labels = np.where(lies, 1 - y, y)
    q = toxicity.vote_posteriors(votes, labels, np.ones(4000))
    by_votes = {}
    for own, p in zip(map(tuple, votes), q):
        assert abs(by_votes.setdefault(own, p) - p) < 1e-9
    silent = votes.sum(axis=1) == 0
    assert (labels[silent] == 1).any() and q[silent].max() < 0.3
    assert q[(votes.sum(axis=1) >= 4)].min() > 0.9
    known = toxicity.label_model(votes, labels, np.ones(4000))
    assert (known == labels).all()


def test_linked_voters_are_not_counted_twice():
    """The posterior of rows on which three linked voters fire, against shares counted
    in the rows, and against the same product with the voters as independent."""
    y, votes = _voters(np.random.default_rng(5), 60_000)
    q = toxicity.vote_posteriors(votes, y, np.ones(len(y)))

    def odds(of_class) -> float:
        return y.mean() / (1 - y.mean()) * of_class(votes[y == 1]) / of_class(votes[y == 0])

    together = odds(lambda v: (v[:, 0] * v[:, 1]).mean() * (v[:, 1] * v[:, 2]).mean() / v[:, 1].mean())
    apart = odds(lambda v: v[:, :3].mean(axis=0).prod())
    got = q[(votes == [1, 1, 1, 0, 0]).all(axis=1)][0]
    assert abs(got - together / (1 + together)) < 1e-3
    assert got < apart / (1 + apart) - 0.02


def test_forest_against_all_spanning_forests():
    y, votes = _voters(np.random.default_rng(6), 3000)
    toxic, clean = y.astype(float), 1.0 - y
    above = toxicity.correlation_forest(votes, toxic, clean)
    assert {frozenset((k, int(p))) for k, p in enumerate(above) if p >= 0} == {frozenset((0, 1)), frozenset((1, 2))}

    def information(a: int, b: int) -> tuple[float, bool]:
        total, linked = 0.0, False
        for label in (0, 1):
            x, z = votes[y == label, a], votes[y == label, b]
            linked |= np.corrcoef(x, z)[0, 1] > toxicity.CORRELATED
            for u, v in itertools.product((0, 1), repeat=2):
                joint = ((x == u) & (z == v)).mean()
                if joint:
                    total += len(x) * joint * np.log(joint / ((x == u).mean() * (z == v).mean()))
        return total, linked

    edges = {(a, b): information(a, b) for a, b in itertools.combinations(range(5), 2)}
    edges = {e: t for e, (t, linked) in edges.items() if linked}
    best = 0.0
    for r in range(len(edges) + 1):
        for chosen in itertools.combinations(edges, r):
            root = list(range(5))
            circle = False
            for a, b in chosen:
                circle |= root[a] == root[b]
                root = [root[a] if x == root[b] else x for x in root]
            if not circle:
                best = max(best, sum(edges[e] for e in chosen))
    got = sum(edges[tuple(sorted((k, int(p))))] for k, p in enumerate(above) if p >= 0)
    assert abs(got - best) < 1e-6 * best


def test_choice_of_voters_against_brute_force():
    rng = np.random.default_rng(8)
    toxic = (rng.random((300, 60)) < rng.random(60) * 0.3).astype(float)
    clean = (rng.random((900, 60)) < 0.004).astype(float)
    given = np.arange(60) < 4
    got = toxicity.choose_voters([np.flatnonzero(r).tolist() for r in toxic], clean.sum(axis=0), 900, given)
    chosen = given.copy()
    while True:
        left = toxic[:, chosen].sum(axis=1) < toxicity.COVER
        scores = []
        for k in range(60):
            n1, n0 = toxic[left, k].sum(), clean[:, k].sum()
            fits = not chosen[k] and n1 >= toxicity.LEAST_TEXTS and n1 / 300 >= toxicity.LEAST_RATIO * n0 / 900
            scores.append(toxicity._contrast(n1, n0, 300, 900) if fits else 0)
        if max(scores) < toxicity.LEAST_Z:
            break
        chosen[int(np.argmax(scores))] = True
    assert (got == chosen).all() and chosen.sum() > 8
    assert (toxicity.choose_voters([], clean.sum(axis=0), 900, given) == given).all()
    assert (toxicity.choose_voters([[0]], clean.sum(axis=0), 0, given) == given).all()


def test_every_needed_voter_is_taken():
    """Six hundred words, each the only sign of thirty texts."""
    toxic = [[k] for k in range(600) for _ in range(30)]
    chosen = toxicity.choose_voters(toxic, np.zeros(600), len(toxic), np.zeros(600, bool))
    assert chosen.all()


def test_features_of_odd_texts():
    long = "x" * 5000
    assert toxicity.features("") == set()
    assert {long, "xxxx-", "xxxxxx-"} <= toxicity.features(long + " " + long)
    votes = np.zeros((5, 0), np.float32)
    q = toxicity.vote_posteriors(votes, np.array([0, 1, -1, 0, 0]), np.ones(5))
    assert np.isfinite(toxicity.fit_linear(votes, q, np.ones(5))).all()
    one = toxicity.vote_posteriors(np.ones((3, 1)), np.array([-1, -1, -1]), np.ones(3))
    assert np.isfinite(one).all()
