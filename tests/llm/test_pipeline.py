"""The whole pipeline against plain Python on a small corpus, and its stages on empty tables."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken

from breakwater.llm import decontaminate, jaccard, pretokens
from breakwater.llm.queries import RANKS

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(words, n):
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def corpus():
    r = random.Random(12)
    say = lambda n, w="w": " ".join(f"{w}{r.randrange(400)}" for _ in range(n))
    item = say(40, "exam")
    block = "\n".join(["first shared line", "second shared line", "third shared line"])
    good = [(k, say(r.randrange(30, 120))) for k in range(40)]
    junk = [(100 + k, say(r.randrange(30, 120), "BUY!!! ")) for k in range(40)]
    base = good[3][1].split()
    near = [(200 + k, " ".join(base[: 40 + k] + [f"new{k}"] + base[41 + k :])) for k in range(4)] + [(210, good[3][1]), (211, good[3][1].upper())]
    lines = [(300, block + "\n" + say(50)), (301, say(60) + "\n" + block + "\nafter " + say(30)), (302, block)]
    leaks = [(400, say(25) + " " + item + " " + say(20)), (401, " ".join(item.split()[:-1] + ["other"])), (402, say(30) + " " + " ".join(item.split()[:12]))]
    rest = [(500, None), (501, ""), (502, "  \n "), (503, "short one"), (504, "short one"), (505, say(9000))]
    docs = good + junk + near + lines + leaks + rest
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 1) for i, _ in junk]
    return docs, labels, [(1, item), (2, "never seen in any of the documents here at all")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, labels, items = corpus()
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs], COLUMNS).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def plain_lines(docs):
    """Texts without the lines of windows of three that stand earlier; emptied ones go."""
    seen, out = {}, []
    for i, t in sorted(docs):
        lines = (t or "").split("\n")
        for p in range(len(lines) - 2):
            if any(lines[p : p + 3]):
                seen.setdefault(tuple(lines[p : p + 3]), (i, p))
    for i, t in sorted(docs):
        lines = (t or "").split("\n")
        gone = {q for p in range(len(lines) - 2) if seen.get(tuple(lines[p : p + 3]), (i, p)) != (i, p) for q in range(p, p + 3)}
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t
        if kept or not t:
            out.append((i, kept))
    return out


def plain_near(docs, width=5, percent=80):
    sets = {i: shingles((t or "").lower().split(), width) for i, t in docs}
    part = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(part)
        for a in sets:
            for b in sets:
                if a < b and part[a] != part[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
        if part == before:
            break
    return [(i, t) for i, t in docs if part[i] == i]


def plain_clean(docs, items):
    def best(words, item):
        count = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
        want, n = count(item), min(len(item), len(words))
        return max((decontaminate.similarity(count(words[k : k + n]), want) for k in range(len(words) - n + 1)), default=0) if n else 0

    return [(i, t) for i, t in docs if not any(best((t or "").lower().split(), x.lower().split()) >= 0.8 for _, x in items if set(x.split()) & set((t or "").split()))]


def test_whole_pipeline(spark, tables):
    docs, labels, items = corpus()
    kept = corpus_pipeline.good(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables)
    assert kept.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    ids = {r.doc_id for r in kept.collect()}
    assert ids >= {i for i, q, _ in labels if q} and not ids & {i for i, q, _ in labels if not q}
    want = plain_clean(plain_near(plain_lines([(i, t) for i, t in docs if i in ids])), items)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pretokens.read_ranks(P.path(RANKS)), special_tokens={})
    rows = []
    for i, t in want:
        tokens = enc.encode_ordinary(t or "")
        rows.append((i, len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = corpus_pipeline.run(spark, tables).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    gone = {i for i, _ in docs} - {i for i, *_ in rows}
    assert {200, 201, 202, 203, 210, 211, 302, 400, 401} & ids <= gone and 402 not in gone | ({402} - ids)


@pytest.mark.parametrize("stage", ["lines", "near", "decontaminate", "bpe"])
def test_stages_take_nothing(spark, tables, stage):
    empty = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    out = dict(corpus_pipeline.STAGES)[stage](spark, empty, tables)
    assert out.count() == 0 and (stage == "bpe" or out.columns == empty.columns)


@pytest.mark.parametrize("seed", [1, 2])
def test_drop_similar(spark, seed):
    r = random.Random(seed)
    base = [f"w{r.randrange(900)}" for _ in range(80)]
    docs = []
    for k in range(40):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"x{r.randrange(99)}"
        docs.append((k, " ".join(w[: 80 - r.randrange(12)])))
    docs += [(50, "one two three four five"), (51, "one two three four five"), (52, "one two three"), (53, "one  two\tthree"), (54, None), (55, ""), (56, "word " * 3000)]
    df = spark.createDataFrame([(i, t, "kept") for i, t in docs], "doc_id long, text string, component_id string").repartition(3)
    got = jaccard.drop_similar(df)
    assert got.columns == df.columns and sorted(x.doc_id for x in got.collect()) == sorted(i for i, _ in plain_near(docs))
