"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from breakwater.llm import bpe, decontaminate, jaccard, linededup, media, pretokens, pseudo, quality, suffix, trie, urltree

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def texts():
    r = random.Random(4)
    words = ["harbour", "Lamp", "über", "tiny", "42", "re-try", "ciudad", "été", "the", "a", "of", "stone", "river", "mirror"] + [f"w{k}" for k in range(200)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = say(120), say(90)
    out = [(1, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, "   \n\t "), (7, "word"), (8, "a" * 3000), (9, "日本語 テスト 🙂🙂"), (10, "\n".join([say(5) for _ in range(6)] + ["same one", "same two", "same three"]))]
    out += [(11, "same one\nsame two\nsame three\n" + say(8)), (12, say(30) + " " + passage + " " + say(25)), (13, passage), (14, say(400)), (14, say(12)), (None, "no id here at all"), (15, base.replace("stone", "rock", 1)), (16, say(40) + "  " + base)]
    return out + [(2, base)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1.5) for i, t in texts()], "doc_id long, text string, n_tokens string, key double").repartition(3)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_bpe(docs):
    ranks = pretokens.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in texts():
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.bpe_roundtrip(docs, RANKS)
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.bpe_roundtrip(docs.where("false"), RANKS).count() == 0


def test_heap_merge_is_the_fold():
    ranks = pretokens.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for word in ("internationalisation", "aaaaaaaaaaaaaaaaaaaaaaa", "zzzyx" * 40):
        assert bpe.heap_merge(word.encode(), ranks) == enc.encode_ordinary(word)


def plain_count(word, costs):
    """Token count and cost of a word by the forward recursion over its bytes."""
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        best.append(min((best[start][0] + c, best[start][1] + 1) for start in range(max(0, end - 140), end) if (c := costs.get(word[start:end])) is not None))
    return best[-1][1], best[-1][0]


def test_trie(spark, docs):
    import regex

    costs = trie.piece_costs(pretokens.read_ranks(RANKS))
    swap = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    more = [(100, swap), (101, swap.translate(str.maketrans("ab", "ba"))), (102, "_" * 700 + "é" * 90)]
    both = docs.unionByName(spark.createDataFrame([(i, t, "x", 1.5) for i, t in more], docs.schema))
    want = []
    for i, t in texts() + more:
        found = [plain_count(w.encode(), costs) for w in regex.findall(P.PATTERN, t or "")]
        want.append((i, len(found), sum(n for n, _ in found), sum(c for _, c in found)))
    for most in (trie.KNOWN, 40):
        assert rows(trie.token_counts(both, RANKS, most_known=most), "doc_id", "n_pretokens", "n_tokens", "cost") == sorted(want, key=repr)


def test_regular_words_keep_apart(spark):
    """Two long words, the second with the first one's letters swapped, share nothing; hashes modulo a power of two would take them for one."""
    swap = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    df = spark.createDataFrame([(1, swap), (2, swap.translate(str.maketrans("ab", "ba"))), (3, swap)], "doc_id long, text string")
    assert rows(jaccard.link_components(df), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 1)]


def test_media(docs):
    got = media.media_column(docs, keep_media=True).collect()
    assert len(got) == len(texts())
    by = {}
    for r in got:
        back, _, about = media.read_ogg(bytes(r.media))
        assert len(back) % 64 == 0 and about["lost"] == 0 and hashlib.sha256(back).hexdigest() == r.payload_sha256 and zlib.crc32(back[-64:]) == r.tail_crc32
        assert by.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    empty = next(r for r in got if r.doc_id == 5)
    assert (empty.n_bytes, empty.payload_bytes) == (0, 64)


def test_ogg_damage():
    stored = bytearray(media.write_ogg(bytes(range(256)) * 400))
    whole = media.demultiplex(bytes(stored))
    assert sum(p["lost"] for p in whole.values()) == 0 and all(p["ended"] for p in whole.values())
    stored[len(stored) // 2] ^= 1
    hurt = media.demultiplex(bytes(stored))
    assert sum(p["lost"] for p in hurt.values()) > 0
    assert {bytes(p) for p, _ in hurt[media.SAMPLES]["packets"]} <= {bytes(p) for p, _ in whole[media.SAMPLES]["packets"]}


def test_lines(docs):
    seen, want, gone_of = {}, [], {}
    different = sorted({(i, t or "") for i, t in texts()}, key=lambda x: (x[0] is not None, x[0] or 0))
    for i, t in sorted(different, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if any(w) and w in seen:
                gone |= {k, k + 1, k + 2}
            seen.setdefault(w, (i, k))
        gone_of[i, t] = len(gone)
    got = {(r.doc_id, r.n_removed) for r in linededup.dedup_lines(docs).collect()}
    assert got == {(i, n) for (i, t), n in gone_of.items()} and any(n for n in gone_of.values())
    kept = linededup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() and kept.where("doc_id = 4 AND text IS NULL").count() == 1


def test_pipeline_lines_keeps_empty_texts(spark):
    block = "\n".join(f"line {k} of the block" for k in range(linededup.WIDTH))
    docs = spark.createDataFrame([(1, block, 1), (2, block, 1), (3, "", 0), (4, None, None), (5, block + "\nmore", 1)], "doc_id long, text string, n_chars long")
    got = corpus_pipeline.lines(spark, docs, "")
    assert got.columns == docs.columns and rows(got, "doc_id", "text", "n_chars") == [(1, block, len(block)), (3, "", 0), (4, None, None), (5, "more", 4)]


def test_suffix(docs):
    length = 40
    every = Counter(b[k : k + length] for _, t in texts() for b in [(t or "").encode()] for k in range(len(b) - length + 1))
    want = []
    for i, t in texts():
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if every[b[k : k + length]] > 1:
                mask[k : k + length] = True
        want.append((i, len(b), int(mask.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    assert rows(suffix.remove_repeats(docs, length=length), "doc_id", "n_bytes", "n_removed", "kept_sha256") == sorted(want, key=repr)


@pytest.mark.parametrize("n,k", [(1, 2), (80, 2), (3000, 3), (4000, 60)])
def test_suffix_array(n, k):
    x = np.random.default_rng(n).integers(0, k, n)
    x = np.concatenate([x, x[: n // 2], np.zeros(n // 5, int)])
    b = x.astype(np.uint8).tobytes()
    assert suffix.suffix_array(x, k).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_jaccard(docs):
    sets = []
    for i, t in texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in w]
        sets.append((i, frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])))
    part = list(range(len(sets)))
    for _ in sets:
        for a, (_, x) in enumerate(sets):
            for b, (_, y) in enumerate(sets):
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    part[a] = part[b] = min(part[a], part[b])
    least = {}
    for p, (i, s) in zip(part, sets, strict=True):
        if s and i is not None:
            least[p] = min(least.get(p, i), i)
    want = sorted(((i, len(s), least.get(p) if s else i) for p, (i, s) in zip(part, sets, strict=True)), key=repr)
    assert rows(jaccard.link_components(docs), "doc_id", "n_shingles", "component_id") == want


def test_leaks(spark, docs):
    passage = dict((i, t) for i, t in texts() if i is not None)[13]
    bench = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "nothing of this is in any text of the table here")], "item_id long, text string")
    got = decontaminate.find_leaks(docs, bench)
    assert rows(got.select("doc_id", "item_id", "similarity"), "doc_id", "item_id", "similarity") == [(12, 1, 1.0), (13, 1, 1.0)]
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    words = passage.split()
    words[40] = "changed"  # five of 86 shingles: 81 of 91 shared
    near = spark.createDataFrame([(1, "before it " + " ".join(words) + " and after")], "doc_id long, text string")
    x = decontaminate.find_leaks(near, bench).first()
    assert x.at == 2 and x.similarity == round(81 / 91, 6) and decontaminate.find_leaks(near, bench.where("item_id = 3")).count() == 0


def test_near_fingerprints():
    items = decontaminate.Items([(k, f"{k} " + " ".join(f"w{k}{j}" for j in range(20))) for k in range(8)])
    flips = np.array([items.prints[3] ^ np.uint64(((1 << n) - 1) << 7) for n in range(0, 40)], np.uint64)
    which, item = items.near(flips)
    assert sorted(which[item == 3].tolist()) == list(range(decontaminate.RADIUS + 1))


def test_quality(spark):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(["calm", "river", "reads", "well", "slowly", "stone"]) for _ in range(30))
    bad = lambda: "!! ".join(r.choice(["BUY", "NOW", "FREE"]) for _ in range(30))
    rows_ = [(k, (good if k % 2 else bad)()) for k in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    got = {x.doc_id: x.score for x in quality.score_quality(docs, model).collect()}
    assert all((got[k] >= quality.THRESHOLD) == (k % 2 == 1) for k in range(80, 120)) and got[500] == got[501] and 0 <= got[500] <= 1
    assert {x.doc_id for x in quality.keep_quality(docs.where("doc_id BETWEEN 80 AND 119"), model).collect()} == set(range(81, 120, 2))
    assert quality.fit_quality(docs, labels.where("false")).curve == (1.0, 0.0)


def test_quality_fits_whole_texts(spark):
    say = [" ".join(f"{w}{k}" for k in range(4000)) for w in ("bad", "good")]
    model = quality.fit_quality(spark.createDataFrame(list(enumerate(say)), "doc_id long, text string"), spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int"))
    row, feature = quality.indicators(*pseudo.utf8(pa.array(say)))
    bad, good = feature[row == 0], feature[row == 1]
    neither = model.ratio[np.setdiff1d(np.arange(1 << quality.BITS), feature)].max()
    assert len(good) > 7000 and (model.ratio[np.setdiff1d(good, bad)] > neither + 0.5).all() and (model.ratio[np.setdiff1d(bad, good)] < neither - 0.5).all()


def test_urls(spark):
    u = ["http://WWW.Example.com/en/a?x", "https://example.com/en/", "http://a.example.com/fr/1", "http://x.net/es/q", "http://x.net/eso", None, "no scheme", "http://h.org", "http://notcom/"]
    pages = spark.createDataFrame(list(enumerate(u)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urltree.judge_urls(pages).collect()}
    assert got[0] == ("www.example.com", "/en/a", "www.example.com/en/", "allow") and got[1][2:] == ("example.com/en/", "block") and got[2][2:] == ("com/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4][:3] == ("x.net", "/eso", None) and got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[7][:3] == ("h.org", "", None) and got[8][2] is None


def test_url_templates(spark):
    rows_ = [(k, f"http://h.org/bad/{k}x{k * 7}") for k in range(60)] + [(100 + k, f"http://h.org/good/{k}y{k * 3}") for k in range(60)]
    pages = spark.createDataFrame(rows_, "page_id long, url string")
    labels = spark.createDataFrame([(k, 1) for k in range(30)] + [(100 + k, 0) for k in range(30)], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in urltree.judge_urls(pages, labels).collect()}
    assert all(got[k] == "block" for k in range(60)) and all(got[100 + k] == "allow" for k in range(60))


def test_url_merges_below_the_first_level(spark):
    bad = [f"http://h.org/shop/b{k}/x" for k in range(4)]
    rows_ = [*enumerate(bad), (10, "http://h.org/shop/g0/x"), (11, "http://h.org/shop/g1/x"), (12, "http://h.org/shop/odd/y")]
    labels = spark.createDataFrame([(k, 1) for k in range(4)] + [(10, 0), (11, 0), (12, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in urltree.judge_urls(spark.createDataFrame(rows_, "page_id long, url string"), labels).collect()}
    assert {got[k].template for k in range(4)} == {"/shop/+bad/x"} and got[12].template == "/shop/odd/y" and got[10].template == got[11].template == "/shop/+good/x"
    p = 0.5  # what lies above the host: more than half of all labels are bad, and so are those of its domain
    for n_bad, labelled in ((5, 7), (5, 7), (4, 4), (4, 4)):  # the host, /shop, /shop/+bad, /shop/+bad/x
        p = (n_bad + 4 * p) / (labelled + 4)
    assert got[0].purity == round(p, 6) and got[0].verdict == "block" and got[10].verdict == "allow"


def test_url_paths_are_followed_to_their_end(spark):
    rows_ = [(k, f"http://h.org/a/b/c/d/bad/{k % 3}/e") for k in range(12)] + [(100 + k, f"http://h.org/a/b/c/d/good/{k % 3}/e") for k in range(12)] + [(200, "http://h.org/a"), (201, "http://h.org/")]
    labels = spark.createDataFrame([(k, 1) for k in range(10)] + [(100 + k, 0) for k in range(10)], "page_id long, bad int")
    pages = spark.createDataFrame(rows_, "page_id long, url string")
    got = {r.page_id: r for r in urltree.judge_urls(pages, labels).collect()}
    assert len(got) == 26 and all(got[k].verdict == "block" and got[k].template.startswith("/a/b/c/d/bad/") for k in range(12)) and all(got[100 + k].verdict == "allow" for k in range(12))
    assert got[200].template == "/a" and got[201].template == ""
    assert {r.template for r in urltree.judge_urls(pages, labels, depth=4).collect()} == {"/a/b/c/d", "/a", ""}


def test_pseudo(docs):
    got = {(r.doc_id, r.n_words): r for r in pseudo.score_pseudo(docs).collect()}
    assert got[4, 0].score is None and got[4, 0].log_prob == 0 and all(r.log_prob < 0 for r in got.values() if r.n_words)


def test_pseudo_learns():
    ids = np.tile(np.array([300, 400, 500, 600, 700], np.int32), 2000)
    around = pseudo.contexts(ids, np.array([0, len(ids)]))
    p = pseudo.start()
    memory = {k: np.full_like(v, 1e-3) for k, v in p.items()}
    first = pseudo.log_probs(p, around, ids).mean()
    for _ in range(60):
        pseudo.log_probs(p, around, ids, 0.05, memory)
    assert pseudo.log_probs(p, around, ids).mean() > first + 3


def test_pseudo_tells_rare_words_apart(spark):
    bucket = lambda w: int(pseudo.word_hashes(*pseudo.utf8(pa.array([w])))[0][0] >> np.uint64(56))
    once = "rare0"
    often = next(w for w in (f"rare{k}" for k in range(1, 9999)) if bucket(w) == bucket(once))
    fill = [" ".join(f"f{k}" for k in range(900))] * 6
    rows_ = [*enumerate(fill), (10, f"f1 f2 {once} f3 f4"), (11, f"f1 f2 {often} f3 f4"), (12, f"{often} f5 {often} f6 {often}")]
    got = {r.doc_id: r.log_prob for r in pseudo.score_pseudo(spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)).collect()}
    assert got[11] - got[10] == pytest.approx(np.log(4), abs=1e-3)


def test_pseudo_does_not_depend_on_partitions(docs, spark):
    say = [" ".join(f"w{(k * j) % 97}" for j in range(200)) for k in range(30)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(say, 100)), "doc_id long, text string"))
    runs = pseudo.RUN
    try:
        pseudo.RUN = 4000  # several runs
        one, many = (rows(pseudo.score_pseudo(both.repartition(n)), "doc_id", "n_words", "log_prob") for n in (1, 6))
    finally:
        pseudo.RUN = runs
    assert one == many


def test_pseudo_beats_single_words(spark):
    """Words that follow from their neighbours score better than their frequency says; the texts asked are not those learnt from."""
    r = random.Random(2)
    cycle = [f"w{k}" for k in range(12)]
    say = lambda: " ".join(cycle[(k + j) % 12] for k in [r.randrange(12)] for j in range(60))
    df = spark.createDataFrame([(k, say()) for k in range(2000)], "doc_id long, text string")
    runs = pseudo._runs(pseudo._texts(df, "doc_id", "text"))
    words, _ = pseudo.learn_vocabulary(pseudo.count_words(runs))
    params = pseudo.train(runs, words)
    hashes, first = pseudo.word_hashes(*pseudo.utf8(pa.array([say() for _ in range(50)])))
    ids = words(hashes)
    assert pseudo.log_probs(params, pseudo.contexts(ids, first), ids).mean() > np.log(1 / 12) + 0.5


def test_empty_tables(docs):
    none = docs.where("false")
    for out in (linededup.dedup_lines(none), suffix.remove_repeats(none), jaccard.link_components(none), media.media_column(none), trie.token_counts(none, RANKS), pseudo.score_pseudo(none)):
        assert out.count() == 0
