"""Stream dedup, filter audit and whitening against plain Python, with nulls, ties, repeated rows, weak hashes and degenerate vectors."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from breakwater.llm import audit, streamdedup, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    r = random.Random(11)
    say = lambda n: " ".join(r.choice(["Stone", "river", "LAMP", "École", "éclair", "x1", "tiny"]) + str(r.randrange(900) if r.random() < 0.7 else "") for _ in range(n))
    out = [(i, say(r.randrange(1, 500))) for i in range(60)]
    out += [(100 + i, out[i % 7][1].upper() if i % 2 else out[i % 7][1]) for i in range(40)]
    out += [(200 + i, "the same text of a third of all rows") for i in range(50)]
    out += [(300, None), (301, ""), (302, " \n\t"), (303, "A" * 40000), (304, "A" * 40000), (304, "A" * 40000), (305, "A" * 39999 + "b"), (305, "x"), (None, "x"), (None, "x"), (None, None)]
    long = say(90000)
    return out + [(400, long), (401, long[:-1] + "!"), (402, long), (403, long[:70] + "#" + long[71:])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 3}" if (i or 0) % 5 else None, "clash", 1.5) for i, t in rows], "doc_id long, text string, source string, id string, n double")


def dedup_rows(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for norm, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        order = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        out += [(i, keep, len(ids), k == 0, hashlib.sha256(norm.encode()).hexdigest()) for k, i in enumerate(order)]
    return sorted(out, key=repr)


def got_rows(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def test_dedup_over_batches_and_runs(spark, tmp_path):
    rows = texts()
    frame(spark, rows[:100]).repartition(5).write.parquet(f"{tmp_path}/docs")
    got = streamdedup.dedup_stream(spark, f"{tmp_path}/docs", folder=f"{tmp_path}/own", batch=1)  # a file a micro-batch
    assert got_rows(got) == dedup_rows(rows[:100])
    frame(spark, rows[100:]).repartition(2).write.mode("append").parquet(f"{tmp_path}/docs")
    again = streamdedup.dedup_stream(spark, f"{tmp_path}/docs", folder=f"{tmp_path}/own", batch=1)
    assert got_rows(again) == dedup_rows(rows)  # the second run reads two files, against the state of the first
    assert len({r.file for r in spark.read.parquet(f"{tmp_path}/own/entries").select("file").distinct().collect()}) == 7
    kept = again.where("kept").select("doc_id", "keep_file", "keep_row", "text_sha256")
    source = spark.read.parquet(f"{tmp_path}/docs").select(F.col("_metadata.file_path").alias("keep_file"), F.col("_metadata.row_index").alias("keep_row"), "text")
    found = kept.join(source, ["keep_file", "keep_row"]).collect()
    assert found and all(hashlib.sha256((r.text or "").translate(LOWER).encode()).hexdigest() == r.text_sha256 for r in found)


def test_dedup_tells_bytes_apart_under_a_weak_digest(spark, tmp_path):
    rows = texts()
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/docs")
    assert got_rows(streamdedup.dedup_stream(spark, f"{tmp_path}/docs", digest=1)) == dedup_rows(rows)
    assert got_rows(streamdedup.dedup_stream(spark, f"{tmp_path}/docs", digest=0)) == dedup_rows(rows)


def test_dedup_of_nothing(spark, tmp_path):
    frame(spark, texts()).where("false").write.parquet(f"{tmp_path}/docs")
    assert got_rows(streamdedup.dedup_stream(spark, f"{tmp_path}/docs")) == []


def audit_rows(rows, good, toxic):
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    failing = []
    for i, t in rows:
        text, words = t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > first[text]}
        failing.append((f"s{(i or 0) % 3}" if (i or 0) % 5 else "", "".join(f for f in "ABCDE" if fails[f]), i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in failing}:
        own = Counter((f, g, x) for p, f, g, x in failing if p == part)
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                hit = lambda test: sum(n for key, n in own.items() if test(*key))
                before = order[:k]
                gone = lambda m, f=f, before=before: f in m and not set(before) & set(m)
                removed = hit(lambda m, g, x: gone(m))
                total[f] += removed
                out[part, order, k + 1] = [hit(lambda m, g, x: not set(order[: k + 1]) & set(m)), removed, hit(lambda m, g, x: f in m and set(before) & set(m)), hit(lambda m, g, x: m == f), hit(lambda m, g, x: gone(m) and g), hit(lambda m, g, x: gone(m) and x)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def labels(spark):
    rows = [(i, int(i % 3 == 0), int(i % 7 == 0)) for i in range(0, 405, 2)]
    return spark.createDataFrame([*rows, (4, 1, 0), (None, 1, 1), (6, None, 1)], "doc_id long, quality int, toxic int"), {i for i, q, _ in rows if q} | {4}, {i for i, _, t in rows if t} | {6}


def test_audit(spark, monkeypatch):
    said, good, toxic = labels(spark)
    docs = frame(spark, texts()).repartition(3)
    want = audit_rows(texts(), good, toxic)
    assert audited(audit.audit_filters(docs, said)) == want
    assert audit.audit_filters(docs.where("false"), said).count() == 0
    monkeypatch.setattr(audit, "_cell", lambda rounds=None: F.xxhash64("length") % 5)  # different texts in one cell
    assert audited(audit.audit_filters(docs, said)) == want
    assert audited(audit.audit_filters(docs, said.where("false"))) == audit_rows(texts(), set(), set())


def test_refinement_drops_what_is_alone(spark):
    alive = audit.refine(audit.facts(frame(spark, texts()))).groupBy("id").count().collect()
    assert {400, 402} <= {r.id for r in alive} and not {401, 403, 305, 302} & {r.id for r in alive if r.id != 305}


def vectors(kind):
    r = np.random.default_rng(5)
    scale = {"wide": np.linspace(1, 4, 40), "narrow": np.array([1.0, 2, 3]), "flat": np.array([3.0, 2, 1] + [0] * 17), "tied": np.ones(12)}[kind]
    return (r.standard_normal((400, len(scale))) * scale / 5).astype(np.float32)


def whitened(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.component, {})[r.vec_id] = (r.n, r.deviation, r.whitened, r.explained, r.identity_error)
    return out


@pytest.mark.parametrize("kind", ["wide", "narrow", "flat", "tied"])
def test_whitening(spark, kind):
    v = vectors(kind)
    v[100:230] = v[7]  # one vector of a third of the rows
    odd = [(1000, None, 0), (1001, [], 0), (1002, [None] * v.shape[1], 0), (1003, [float("nan")] * v.shape[1], 0), (1004, [float("inf")] + [0.0] * (v.shape[1] - 1), 0), (1005, [0.5] * (v.shape[1] + 1), 0)]
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)] + odd, "vec_id long, embedding array<float>, x int").repartition(5)
    got = whitened(whitening.whiten(df))
    x = np.floor(1024 * v.astype(float)).astype(int) + 100000
    off = len(x) * x - x.sum(0)
    y = off / len(x)
    values, turn = np.linalg.eigh(y.T @ y / len(x))
    values, turn = values[::-1], turn[:, ::-1]
    assert sorted(got) == list(range(1, {"wide": 8, "narrow": 3, "flat": 3, "tied": 8}[kind] + 1))
    for c, rows in got.items():
        assert sorted(rows) == list(range(len(v)))
        want = y @ turn[:, c - 1] / np.sqrt(values[c - 1])
        mine = np.array([rows[i][2] for i in range(len(v))])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
        assert [rows[i][1] for i in range(len(v))] == [int(e) for e in (off**2).sum(1)]
        assert {r[0] for r in rows.values()} == {len(v)} and {r[4] for r in rows.values()}.pop() < 1e-9
        assert abs(rows[0][3] - values[c - 1] / values.sum()) < 1e-9 * rows[0][3]


def test_whitening_of_little(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0  # no variance
    huge = whitening.whiten(spark.createDataFrame([(None, [1e30, 2.0]), (2, [-1e30, 2.0]), (2, [-1e30, 2.0])], kind)).collect()
    assert sorted(((r.vec_id, r.component, r.deviation) for r in huge), key=repr) == [(2, 1, None), (2, 1, None), (None, 1, None)]


def test_lanczos_restarts():
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.standard_normal((300, 300)))[0]
    values = np.linspace(1, 300, 300)[::-1]
    matrix = (q * values) @ q.T
    got, turn = whitening.lanczos(lambda b: matrix @ b, 300, 5, basis=3, extra=3)  # a full basis is cut to its Ritz vectors
    assert np.abs(got - values[:5]).max() < 1e-8 and np.abs(np.abs((turn * q[:, :5]).sum(0)) - 1).max() < 1e-8
    low = (q[:, :2] * [9.0, 4]) @ q[:, :2].T  # two dimensions: the second block brings nothing new
    got, turn = whitening.lanczos(lambda b: low @ b, 300, 4)
    assert np.abs(got - [9, 4, 0, 0]).max() < 1e-10 and np.abs(turn.T @ turn - np.eye(4)).max() < 1e-12
