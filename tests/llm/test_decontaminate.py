"""Every item at a similarity of 0.8 or more is found: plain, repetitive, table-like and short ones, against all windows."""

import random
from collections import Counter

import pytest

from breakwater.llm import decontaminate as D


def shingles(words):
    n = min(5, len(words))
    return Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def best(words, item):
    """The similarity of the best window of the item's length, looking at every one."""
    want, n = shingles(item), min(len(item), len(words))
    return max((D.similarity(shingles(words[k : k + n]), want) for k in range(len(words) - n + 1)), default=0.0)


def items_of(kind, r):
    say = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    return {
        "plain": lambda: say(60), "alternating": lambda: ["a", "b"] * 50 + say(11), "table": lambda: ["|", "-"] * 60 + say(8), "four": lambda: ["north", "east", "south", "west"] * 15 + say(5),
        "short": lambda: say(r.randrange(5, 16)), "half": lambda: say(40) + ["na"] * 40, "one": lambda: ["ha"] * 30 + say(1),
    }[kind]()


@pytest.mark.parametrize("kind", ["plain", "alternating", "table", "four", "short", "half", "one"])
def test_all_similar_windows_are_found(spark, kind):
    r = random.Random(len(kind))
    own = [items_of(kind, r) for _ in range(12)]
    docs = []
    for k, item in enumerate(own):
        for _ in range(12):
            copy = list(item)
            for _ in range(r.randrange(0, 3)):
                copy[-1 - r.randrange(min(12, len(copy)))] = f"x{r.randrange(9999)}"
            docs.append([f"y{r.randrange(9999)}" for _ in range(r.randrange(30))] + copy + [f"z{r.randrange(9999)}" for _ in range(r.randrange(30))])
        docs.append(["a", "b"] * 200)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(own)], "item_id long, text string")
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(docs)], "doc_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in D.find_leaks(df, bench).collect()}
    want = {(d, i): s for d, words in enumerate(docs) for i, item in enumerate(own) if set(item) & set(words) and (s := best(words, item)) >= 0.8}
    assert set(got) == set(want) and len(want) > 30
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_nothing_and_repeats(spark):
    kind = "doc_id long, text string, item_id string"
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (None, "red green blue")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five six seven eight", "x"), (1, "zero one two three four five six seven eight", "x"), (2, None, "x"), (3, "", None), (None, "a red green blue b", None), (4, "red blue green", "x")], kind)
    got = sorted(((x.doc_id, x.item_id, x.at, x.n_words) for x in D.find_leaks(docs, bench).collect()), key=repr)
    assert got == [(1, 1, 1, 7), (1, 1, 1, 7), (None, None, 1, 3)]
    assert D.find_leaks(docs.where("false"), bench).count() == 0 and D.find_leaks(docs, bench.where("false")).count() == 0
    assert sorted((x.doc_id for x in D.drop_leaks(docs, bench).collect())) == [2, 3, 4] and D.drop_leaks(docs, bench).columns == docs.columns
    words = [f"v{k % 700}" for k in range(60000)]
    long = spark.createDataFrame([(9, " ".join(words[:50000] + ["p", "q"] * 20 + words[50000:]), None)], kind)
    found = D.find_leaks(long, spark.createDataFrame([(5, " ".join(["p", "q"] * 20)), (6, " ".join(words[100:160]))], "item_id long, text string")).collect()
    assert {(x.item_id, x.at) for x in found} == {(5, 50000), (6, 100)}
