import random

import numpy as np
import pytest

from tests.llm.conftest import DOCUMENT, ODD_ROWS
from tillflow.llm import set_sketch


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute(docs):
    """(id, set size, component, kept) by comparing each two distinct sets that have a word sequence in common."""
    ids_of, having = {}, {}
    for i, text in docs:
        ids_of.setdefault(shingles(text), []).append(i)
    sets = [s for s in ids_of if s]
    for k, s in enumerate(sets):
        for x in s:
            having.setdefault(x, []).append(k)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        for j in {j for x in s for j in having[x] if j > k}:
            both = len(s & sets[j])
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                root[find(j)] = find(k)
    low = {}
    for k, s in enumerate(sets):
        known = [i for i in ids_of[s] if i is not None]
        low[find(k)] = min([*known, *[x for x in [low.get(find(k))] if x is not None]], default=None)
    place = {s: k for k, s in enumerate(sets)}
    out = []
    for i, text in docs:
        s = shingles(text)
        component = low[find(place[s])] if s else i
        out.append((i, len(s), component, component is None or i == component))
    return out


def as_sorted(found):
    return sorted(found, key=lambda r: [(v is None, str(v)) for v in r])


def found(df):
    return as_sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts], DOCUMENT)


def edited(seed, texts=60, words=400):
    rng, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(500)]
    for _ in range(texts):
        first = [rng.choice(vocabulary) for _ in range(words)]
        out.append(" ".join(first))
        for edits in (1, 3, 5, 6, 7, 8, 12):
            copy = list(first)
            for at in rng.sample(range(words), edits):
                copy[at] = f"changed{rng.random()}"
            out.append(" ".join(copy))
    return list(enumerate(out))


def couples(template, own, pair, number):
    """Texts on one template, in couples: words of the template, of the couple, and of each text, each in a block."""
    base = [f"t{i}" for i in range(template)]
    out = []
    for c in range(number):
        for side in "ab":
            out.append(" ".join(base + [f"p{c}x{i}" for i in range(pair)] + [f"o{c}{side}{i}" for i in range(own)]))
    return list(enumerate(out))


def test_edited_copies(spark):
    texts = edited(3)
    expected = as_sorted(brute(texts))
    assert sum(r[3] for r in expected) < len(texts) / 2
    assert found(set_sketch.near_copy_components(frame(spark, texts))) == expected


@pytest.mark.parametrize(("template", "own", "pair"), [(200, 15, 4), (200, 14, 8), (100, 6, 4), (200, 11, 12)])
def test_couples_on_one_template(spark, template, own, pair):
    """All texts meet in the same buckets, and only the two of a couple are similar enough."""
    texts = couples(template, own, pair, 150)
    a, b, c = (shingles(texts[i][1]) for i in (0, 1, 2))
    assert 100 * len(a & b) >= 85 * len(a | b) and 72 * len(a | c) < 100 * len(a & c) < 85 * len(a | c)
    assert found(set_sketch.near_copy_components(frame(spark, texts))) == as_sorted(brute(texts))


def test_corpus(table):
    docs = table("documents", "sf0.01")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert found(set_sketch.near_copy_components(docs)) == as_sorted(expected)
    assert {r.doc_id for r in set_sketch.drop_near_copies(docs).collect()} == {r[0] for r in expected if r[3]}


def test_a_large_group_beside_a_stranger(spark):
    rng = random.Random(9)
    first = [f"w{i}" for i in range(200)]
    group = [list(first) for _ in range(900)]
    for text in group:
        text[rng.randrange(200)] = f"changed{rng.random()}"
    far = first[:150] + [f"own{i}" for i in range(20)]
    near = list(far)
    near[-1] = "other"
    texts = list(enumerate(map(" ".join, [*group, far, near, ["an", "other"], []])))
    assert found(set_sketch.near_copy_components(frame(spark, texts))) == as_sorted(brute(texts))


def test_odd_rows(odd):
    assert found(set_sketch.near_copy_components(odd)) == as_sorted(brute([r[:2] for r in ODD_ROWS]))
    kept = set_sketch.drop_near_copies(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 10] and ids.count(None) == 2


def test_empty_table(none):
    assert set_sketch.near_copy_components(none).count() == 0
    assert set_sketch.drop_near_copies(none).count() == 0


def test_sketches_merge():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1 << 63, 3000, np.uint64)) for _ in range(2))
    union = set_sketch.registers(np.union1d(a, b))
    assert (union == set_sketch.merged(set_sketch.registers(a), set_sketch.registers(b))).all()
    assert (set_sketch.registers(np.zeros(0, np.uint64)) == 0).all()


@pytest.mark.parametrize("share", [0.0, 0.5, 0.85, 0.95, 1.0])
def test_estimates(share):
    """Mean and spread of the estimate over made sets, also of different sizes."""
    rng, errors = np.random.default_rng(2), []
    for k in range(60):
        n = 200 + 40 * k
        common = round(2 * n * share / (1 + share))
        words = np.unique(rng.integers(0, 1 << 63, 2 * n, np.uint64))[: 2 * n - common]
        a, b = np.sort(words[:n]), np.sort(words[len(words) - n :])
        if share < 0.9 and k % 2:
            b = np.union1d(b, rng.integers(0, 1 << 63, 5, np.uint64))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sketches = [set_sketch.registers(x)[None] for x in (a, b)]
        errors.append(float(set_sketch.estimate(*sketches, np.array([len(a)]), np.array([len(b)]))[0]) - exact)
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < set_sketch.MARGIN
