"""Language-model scoring by masked pseudo-likelihood: every word is predicted from the words on both its sides.

A small window network (context embeddings weighted by place, a tanh layer, a two-level softmax over classes and their words) is trained
in numpy. Texts are dealt into runs by a hash of what they are, whatever partitions they came in; each run takes one pass over its
texts in the order of that hash from the same start, masking every other word, then the words between, and the runs' parameters are averaged by their numbers of
words, as whole numbers, so that the sum does not depend on its order either. The network tells apart the most frequent words of the
whole corpus and hashed buckets of all others; a word in a bucket is predicted as its bucket by the network, then as itself by its share of the
bucket's words in the corpus. Those counts grow with the corpus: they are summed in shards of words and sent back only to the runs
of texts that hold the word, so nobody holds them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.llm.textvec import slices, utf8, word_hashes
from breakwater.plans.lineage import cut, cut_by

CLASSES, MEMBERS = 32, 32
BUCKETS = 256
WIDE = 16
OFFSETS = (-2, -1, 1, 2)
BATCH = 2048
#: Bytes of text in a run, and shards (by the leading bits of their hash) over which its words are dealt.
RUN = 16 << 20
SHARD_BITS = 10
RATE = 0.2
#: What a parameter is rounded to before runs are averaged.
UNIT = 1 << 20
_SHAPES = {"embed": (CLASSES * MEMBERS + 1, WIDE), "place": (len(OFFSETS), WIDE), "hidden": (WIDE,), "classes": (WIDE, CLASSES), "class_bias": (CLASSES,), "words": (CLASSES, WIDE, MEMBERS), "word_bias": (CLASSES, MEMBERS)}


def start(seed: int = 3) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    out = {k: (draw.standard_normal(s) * 0.1).astype(np.float32) for k, s in _SHAPES.items()}
    out["place"] += 0.5
    return out


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in _SHAPES])


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


class Vocabulary:
    """Word hashes in order with their ids; the rest go to ``BUCKETS`` buckets by hash."""

    def __init__(self, hashes: list[int]):
        x = np.array(hashes, np.int64).view(np.uint64)
        order = np.argsort(x)
        self.hashes, self.ids = x[order], order.astype(np.int32) + BUCKETS

    def __call__(self, words: np.ndarray) -> np.ndarray:
        bucket = (words >> np.uint64(56)).astype(np.int32)
        if not len(self.hashes):
            return bucket
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.ids[at], bucket)


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ids at each of ``OFFSETS`` from each word; beyond a text's ends the id that stands for nothing."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(ids))
    out = np.full((len(OFFSETS), len(ids)), CLASSES * MEMBERS, np.int32)
    for k, offset in enumerate(OFFSETS):
        ok = (at + offset >= first[row]) & (at + offset < first[row + 1])
        out[k, ok] = ids[at[ok] + offset]
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def log_probs(p: dict[str, np.ndarray], around: np.ndarray, ids: np.ndarray, learn: float = 0.0, memory: dict | None = None) -> np.ndarray:
    """ln P(word | both sides) of each word; with ``learn``, one step of Adagrad on these words as well."""
    seen = [p["embed"][around[k]] for k in range(len(OFFSETS))]
    hidden = np.tanh(sum(e * p["place"][k] for k, e in enumerate(seen)) + p["hidden"])
    group, member = ids // MEMBERS, ids % MEMBERS
    classes = _softmax(hidden @ p["classes"] + p["class_bias"])
    n, rows = len(ids), np.arange(len(ids))
    out = np.log(classes[rows, group] + 1e-12)
    # Words in the order of their classes: each class takes matrix products of its own slice, everything else is done for all at once.
    order = np.argsort(group.astype(np.uint8), kind="stable")
    ranked, inner, chosen = group[order], hidden[order], member[order]
    used = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ids) else np.zeros(0, np.int64)
    spans = list(zip(ranked[used].tolist(), used.tolist(), np.append(used, len(ids))[1:].tolist(), strict=True))
    words = p["word_bias"][ranked]
    for c, a, b in spans:
        words[a:b] += inner[a:b] @ p["words"][c]
    words = _softmax(words)
    out[order] += np.log(words[rows, chosen] + 1e-12)
    if learn:
        classes[rows, group] -= 1
        words[rows, chosen] -= 1
        grads = {"classes": hidden.T @ classes, "class_bias": classes.sum(axis=0), "words": np.zeros_like(p["words"]), "word_bias": np.zeros_like(p["word_bias"])}
        back, below = classes @ p["classes"].T, np.empty_like(inner)
        for c, a, b in spans:
            grads["words"][c] = inner[a:b].T @ words[a:b]
            below[a:b] = words[a:b] @ p["words"][c].T
        grads["word_bias"][ranked[used]] = np.add.reduceat(words, used, axis=0)
        back[order] += below
    if learn:
        back *= 1 - hidden * hidden
        grads["hidden"] = back.sum(axis=0)
        grads["place"] = np.stack([(back * e).sum(axis=0) for e in seen])
        grads["embed"] = np.zeros_like(p["embed"])
        for k in range(len(OFFSETS)):
            step = back * p["place"][k]
            by = np.argsort(around[k].astype(np.uint16), kind="stable")
            keys = around[k][by]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            grads["embed"][keys[starts]] += np.add.reduceat(step[by], starts, axis=0)
        for k, g in grads.items():
            g = g / n
            memory[k] += g * g
            p[k] -= (learn * g / (np.sqrt(memory[k]) + 1e-6)).astype(np.float32)
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _summed(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words in order, their summed counts, and each given word's place among them."""
    order = np.argsort(words, kind="stable")
    ranked = words[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(words) else np.zeros(0, bool)
    place = np.empty(len(words), np.int64)
    place[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return ranked[starts], np.add.reduceat(n[order], starts) if len(starts) else n[:0], place


def _runs(texts: DataFrame) -> DataFrame:
    """The texts with the run they are in and the hash that puts them there, written once into buckets of runs, in order."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    dealt = texts.withColumn("hash", F.xxhash64("doc_id", "text")).withColumn("run", F.pmod("hash", F.lit(max(1, -(-size // RUN)))))
    return cut_by(dealt.select("run", "hash", "doc_id", "text"), "run", "hash")


def count_words(runs: DataFrame) -> DataFrame:
    """Counts of all words over the corpus: ``run, words, n, mass``, each row of one shard of words.

    Rows with a run hold those of its words that the corpus has more than once; a word it does not find there occurs once. Rows
    without hold the shard's most frequent words and, as ``mass``, the number of all its words with repeats.
    """

    def count(batches):
        for batch in batches:
            runs_of = batch.column("run").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], runs_of[1:] != runs_of[:-1], [True]])) if len(runs_of) else np.zeros(1, int)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                parts = []
                for piece in slices(iter([batch.slice(a, b - a)]), "text"):
                    words = word_hashes(*utf8(piece.column("text")))[0]
                    parts.append(_summed(words, np.ones(len(words), np.int64))[:2])
                words, n, _ = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                shard = (words >> np.uint64(64 - SHARD_BITS)).astype(np.int32)
                at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])).tolist() if len(words) else [0]
                spans = list(zip(at[:-1], at[1:], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(shard[at[:-1]]), pa.array(np.full(len(spans), runs_of[a])), pa.array([words[i:j].tobytes() for i, j in spans], pa.binary()), pa.array([n[i:j].tobytes() for i, j in spans], pa.binary())], names=["shard", "run", "words", "n"])

    def total(table):
        blobs = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        words, sums, place = _summed(np.concatenate(blobs), np.concatenate([np.frombuffer(x, np.int64) for x in table.column("n").to_pylist()]))
        out, at, all_n = [], 0, sums[place]
        for run, own in zip(table.column("run").to_pylist(), blobs, strict=True):
            n = all_n[at : at + len(own)]
            at += len(own)
            out.append((run, own[n > 1].tobytes(), n[n > 1].tobytes(), None))
        top = np.lexsort((words.view(np.int64), -sums))[: CLASSES * MEMBERS - BUCKETS]
        out.append((None, words[top].tobytes(), sums[top].tobytes(), int(sums.sum())))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["run", "words", "n", "mass"])

    return cut(runs.mapInArrow(count, "shard int, run long, words binary, n binary").groupBy("shard").applyInArrow(total, "run long, words binary, n binary, mass long"))


def learn_vocabulary(counts: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The most frequent words of all texts (ties go to the lower hash), and how many other words each bucket has, with repeats."""

    def spread(batches):
        for batch in batches:
            for words, n in zip(batch.column("words").to_pylist(), batch.column("n").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int64)), pa.array(np.frombuffer(n, np.int64))], names=["word", "n"])

    def masses(batches):
        for batch in batches:
            first = [int(np.frombuffer(w, np.uint64)[0] >> np.uint64(56)) for w in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), batch.column("mass")], names=["bucket", "mass"])

    shards = counts.where("run IS NULL").select("words", "n", "mass")
    top = shards.mapInArrow(spread, "word long, n long").orderBy(F.desc("n"), "word").limit(CLASSES * MEMBERS - BUCKETS).collect()
    mass = np.zeros(BUCKETS)
    for r in shards.mapInArrow(masses, "bucket int, mass long").groupBy("bucket").agg(F.sum("mass").alias("mass")).collect():
        mass[r.bucket] = r.mass
    for r in top:
        mass[(r.word & (1 << 64) - 1) >> 56] -= r.n
    return Vocabulary([r.word for r in top]), mass


def steps(n: int) -> list[slice]:
    """Which of ``n`` words each step masks: of every stretch first the even ones, then those between, so each word is masked once."""
    return [slice(a, k + 2 * BATCH, 2) for k in range(0, n, 2 * BATCH) for a in range(k, min(k + 2, n))]


def train(runs: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """One pass of every run over all its texts, then the mean of their parameters weighted by words."""
    begin = start()

    def fit(run: pa.Table) -> pa.Table:
        p = {k: v.copy() for k, v in begin.items()}
        memory = {k: np.full_like(v, 1e-3) for k, v in p.items()}
        total = 0
        order = np.argsort(run.column("hash").to_numpy(), kind="stable")  # rows of one hash are the same row
        for batch in slices(iter(run.take(pa.array(order)).combine_chunks().to_batches()), "text"):
            words, first = word_hashes(*utf8(batch.column("text")))
            ids = vocabulary(words)
            around = contexts(ids, first)
            for own in steps(len(ids)):
                log_probs(p, around[:, own], ids[own], RATE, memory)
            total += len(ids)
        values = np.rint(flat(p).astype(np.float64) * UNIT).astype(np.int64) * total
        return pa.table({"at": pa.array(np.arange(len(values), dtype=np.int32)), "value": pa.array(values), "weight": pa.array(np.full(len(values), total))})

    fitted = runs.select("run", "hash", "text").groupBy("run").applyInArrow(fit, "at int, value long, weight long")
    mean = fitted.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("weight").alias("weight"))
    values = flat(begin).astype(np.float64)
    for r in mean.where("weight > 0").collect():  # as many rows as the network has parameters
        values[r.at] = int(r.value) / (r.weight * UNIT)
    return unflat(values)


def score_pseudo(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all texts and score each: ``doc_id, n_words, log_prob`` (summed) and ``score`` (the mean; null without words).

    A word outside the network's vocabulary adds ln P(bucket | both sides) and the logarithm of its share of the bucket's words.
    Null and empty texts have no words and a ``log_prob`` of 0. Repeated rows give equal rows; other columns are left out. The same
    rows give the same result however they are partitioned.
    """
    texts = _texts(docs, id_col, text_col)
    runs = _runs(texts)
    counts = count_words(runs)
    vocabulary, mass = learn_vocabulary(counts)
    params = train(runs, vocabulary)

    def score(own, found):
        known, n_known = (np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in found.column(c).to_pylist())]) for c, t in (("words", np.uint64), ("n", np.int64)))
        # A run that was counted in several batches brings a word's total more than once; any of them is found.
        order = np.argsort(known, kind="stable")
        known, n_known = np.append(known[order], np.uint64(2**64 - 1)), np.append(n_known[order], 1)
        out = []
        for batch in slices(iter(own.to_batches()), "text"):
            words, first = word_hashes(*utf8(batch.column("text")))
            ids = vocabulary(words)
            around = contexts(ids, first)
            parts = [log_probs(params, around[:, k : k + 8 * BATCH], ids[k : k + 8 * BATCH]) for k in range(0, len(ids), 8 * BATCH)]
            each = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
            rare = np.flatnonzero(ids < BUCKETS)
            at = np.searchsorted(known, words[rare])
            each[rare] += np.log(np.where(known[at] == words[rare], n_known[at], 1) / mass[ids[rare]])
            sums = np.concatenate([[0.0], np.cumsum(each)])
            n = np.diff(first)
            total = np.round(np.diff(sums[first]), 4)
            mean = pa.array(np.round(total / np.maximum(n, 1), 6), mask=n == 0)
            out.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(total), mean], names=["doc_id", "n_words", "log_prob", "score"]))
        return pa.Table.from_batches(out)

    found = counts.where("run IS NOT NULL").select("run", "words", "n")
    return runs.drop("hash").groupBy("run").cogroup(found.groupBy("run")).applyInArrow(score, "doc_id long, n_words long, log_prob double, score double")
