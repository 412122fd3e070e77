"""Cases of size: near copies on both sides of the limit around shared passages, and caches of words that hold little or nothing."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from breakwater.llm import bpe, jaccard, pretokens, suffix

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def sets_of(texts):
    out = {}
    for i, t in texts:
        w = t.split()
        out[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])
    return out


def components(texts, percent):
    sets = sets_of(texts)
    part = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and part[a] != part[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
                    changed = True
    return {i: (len(sets[i]), part[i]) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_links_near_the_limit(spark, seed):
    r = random.Random(seed)
    say = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    passages, texts = [say(60), say(45)], []
    for i in range(70):
        w = say(r.randint(0, 8)) + passages[i % 2] + say(r.randint(0, 8))
        if i % 3 == 0:
            w[r.randrange(len(w))] = "changed"
        texts.append((i + 1, " ".join(w)))
    base = say(300)
    for i in range(30):
        w = list(base)
        for _ in range(i % 9):
            w[r.randrange(len(w))] = f"x{r.randrange(50)}"
        texts.append((100 + i, " ".join(w[: 300 - i])))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {row.doc_id: (row.n_shingles, row.component_id) for row in jaccard.link_components(df).collect()}
    assert got == components(texts, 85)


def test_words_outside_the_cache(spark):
    r = random.Random(7)
    words = ["naïve", "re-entry", "12345", "日本", "harbour", "x" * 500, "​", "été"] + ["".join(r.choice("aeioustrn") for _ in range(r.randint(1, 14))) for _ in range(150)]
    df = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(60))) for i in range(40)], "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, bpe.bpe_roundtrip(df, RANKS).collect()))
    for sample, head in ((1, 4), (40, 0), (40, 30)):
        assert sorted(map(tuple, bpe.bpe_roundtrip(df, RANKS, sample_docs=sample, most_words=head).collect())) == want
    back = bpe.bpe_roundtrip(df, RANKS, keep=True).join(df, "doc_id")
    assert back.where(F.decode("decoded", "UTF-8") == F.col("text")).count() == 40


def test_runs_keep_rows_whole():
    r = random.Random(1)
    for _ in range(200):
        docs = [(i, [f"w{r.randrange(9)}" for _ in range(r.choice([0, 0, 1, 3, 7, 30]))]) for i in range(r.randrange(1, 12))]
        rows = [(i, p, w[k : k + 10]) for i, w in docs for p, k in enumerate(range(0, max(len(w), 1), 10))]
        batches, k = [], 0
        while k < len(rows):
            n = r.randrange(1, 5)
            part, k = rows[k : k + n], k + n
            batches.append(pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int32()), pa.array([x[2] for x in part], pa.list_(pa.string()))], names=["id", "part", "words"]))
        got = []
        for ids, at, words in pretokens.word_runs(iter(batches), r.choice([1, 5, 20, 1000])):
            words = words.to_pylist()
            got += [(i, words[at[j] : at[j + 1]]) for j, i in enumerate(ids)]
        assert got == docs


def test_suffix_at_full_length(spark):
    """Strings of 400 bytes against brute force: one array, and many small shards with anchors of too many spans for one."""
    r = random.Random(11)
    say = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    passages = [say(90), say(75), "ab" * 230, say(66)]
    texts = [(i, say(r.randint(0, 60)) + passages[i % 4][i % 5 :] + say(r.randint(1, 40)) + passages[(i * 7 + 1) % 4]) for i in range(24)]
    texts += [(100, None), (101, ""), (102, passages[0]), (103, "é" * 900), (104, say(200)), (105, say(50)), (106, texts[3][1]), (106, texts[3][1])]
    n = suffix.LENGTH
    raws = [(i, (t or "").encode()) for i, t in texts]
    every = Counter(b[k : k + n] for _, b in raws for k in range(len(b) - n + 1))
    want = []
    for i, b in raws:
        gone = bytearray(len(b) + 1)
        for k in range(len(b) - n + 1):
            if every[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        want.append((i, len(b), sum(gone), sum(gone[k] and not gone[k + 1] for k in range(len(b))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    assert sum(w[3] > 1 for w in want) > 5
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for shard, most in ((suffix.SHARD, suffix.SPANS), (3000, 2)):
        got = [tuple(x) for x in suffix.remove_repeats(df, shard=shard, most_spans=most).collect()]
        assert sorted(got) == sorted(want)


def test_suffix_brings_no_anchor_together(spark, monkeypatch):
    """One passage in many different surroundings: its spans meet under few anchors, and no sorted join is by the anchor alone."""
    r = random.Random(12)
    say = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    passage = say(60)
    df = spark.createDataFrame([(i, f"{say(80)} {passage} {say(80)}") for i in range(60)], "doc_id long, text string").repartition(3)
    plans, cut = [], suffix.cut
    monkeypatch.setattr(suffix, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {most: sorted(map(tuple, suffix.remove_repeats(df, length=200, most_spans=most).collect())) for most in (suffix.SPANS, 8)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got[8] == got[suffix.SPANS] and all(x[2] >= len(passage) for x in got[8])
    assert any("SortMergeJoin [anchor#" in p for p in plans) and not [p for p in plans if re.search(r"SortMergeJoin \[anchor#\d+L?\],", p)]


def test_held_out_without_id(spark):
    """The fold of the contract; a row without an id is in none."""
    from zlib import crc32

    from breakwater.llm.queries import held_out

    got = spark.createDataFrame([(k,) for k in (None, *range(40))], "doc_id long").select("doc_id", held_out().alias("out")).collect()
    assert all(r.out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and any(r.out for r in got)
