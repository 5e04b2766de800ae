"""The difference-cover suffix array against sorting, and against operator 2."""

import random

import pytest

from waymark.llm import suffix_array as sa


@pytest.mark.parametrize(("n", "letters"), [(1, "ab"), (50, "a"), (400, "ab"), (401, "abc"), (402, "abcdefgh")])
def test_ranks(spark, monkeypatch, n, letters):
    monkeypatch.setattr(sa, "BASE", 40)
    rng = random.Random(n)
    names = [ord(rng.choice(letters)) for _ in range(n)]
    seq = spark.createDataFrame(list(enumerate(names)), "pos long, name long").repartition(3)
    got = {r["pos"]: r["rank"] for r in sa.suffix_ranks(seq, n).collect()}
    order = sorted(range(n), key=lambda i: names[i:])
    assert got == {p: k for k, p in enumerate(order)}


def test_repeats_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sa, "BASE", 200)
    rng = random.Random(2)
    parts = ["".join(rng.choice("ab é") for _ in range(rng.randint(20, 60))) for _ in range(6)]
    rows = [(k * 3, "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))) for k in range(14)] + [(100, None)]
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], doc), doc)
    want = {(doc, i) for doc, text in rows for b in [(text or "").encode()] for i in range(len(b) - 49) if first[b[i : i + 50]] < doc}
    got = sa.repeated_starts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {(r["doc_id"], r["start"]) for r in got.collect()} == want and want
