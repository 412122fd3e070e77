"""The template tree against a plain one built in Python, and what it decides without labels."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from breakwater.llm import urltree as U


def plain_tree(pages, labels, varied=U.VARIED, few=U.FEW, alike=U.ALIKE, prior=U.PRIOR, reject=U.REJECT):
    """{(host, segments): (template, purity)} of (host, segments, page) rows, by recursion over groups of pages."""
    shape = lambda s: re.sub("[0-9]+", "#", re.sub("[0-9a-fA-F]{8,}", "#", s))
    template = {}

    def grow(rows, level, name):
        deeper = []
        for r in rows:
            if len(r[1]) > level:
                deeper.append(r)
            else:
                template[r] = name
        seen = {r[1][level] for r in deeper}
        free = lambda n: n > few and n > varied * len(deeper)
        kinds = {(shape(x)) for x in seen}
        children = defaultdict(list)
        for r in deeper:
            x = r[1][level]
            children["*" if free(len(seen)) and free(len(kinds)) else shape(x) if free(len(seen)) else x].append(r)
        for step, own in children.items():
            grow(own, level + 1, (*name, step))

    for host in {p[0] for p in pages}:
        grow([p for p in pages if p[0] == host], 0, ())
    merged = {}

    def merge(rows, name):  # rows: (row, what is left of its template)
        branches = defaultdict(list)
        for r, rest in rows:
            if rest:
                branches[rest[0]].append((r, rest[1:]))
            else:
                merged[r] = name
        below = {k: Counter(rest for _, rest in b) for k, b in branches.items()}
        mean = sum(below.values(), Counter())
        dot = lambda x, y: sum(n * y[k] for k, n in x.items())
        counts = {k: (sum(labels.get(r[2], 0) for r, _ in b), sum(r[2] in labels for r, _ in b)) for k, b in branches.items()}
        groups = defaultdict(list)
        for k, c in below.items():
            if dot(c, mean) >= alike * math.sqrt(dot(c, c)) * math.sqrt(dot(mean, mean)):
                bad, n = counts[k]
                groups["none" if not n else "bad" if bad > reject * n else "good"].append(k)
        names = {}
        for g, ks in groups.items():
            bad, n = (sum(counts[k][j] for k in ks) for j in (0, 1))
            near = [k for k in ks if abs(counts[k][0] * n - bad * counts[k][1]) <= 2 * (1 - alike) * counts[k][1] * n]
            names.update({k: "+" + g for k in near if len(near) > 1})
        pooled = defaultdict(list)
        for k, b in branches.items():
            pooled[names.get(k, k)] += b
        for k, b in pooled.items():
            merge(b, (*name, k))

    for host in {p[0] for p in pages}:
        merge([(r, template[r]) for r in pages if r[0] == host], ())
    share = min(sum(labels.values()) / len(labels) if labels else 0.0, reject)
    out = {}
    for r in pages:
        p, parts = share, r[0].split(".")
        for k in range(1, len(parts)):
            under = [x for x in pages if x[0].split(".")[-k:] == parts[-k:]]
            p = (sum(labels.get(x[2], 0) for x in under) + prior * p) / (sum(x[2] in labels for x in under) + prior)
        p = min(p, reject)
        for k in range(len(merged[r]) + 1):
            under = [x for x in pages if x[0] == r[0] and merged[x][:k] == merged[r][:k]]
            p = (sum(labels.get(x[2], 0) for x in under) + prior * p) / (sum(x[2] in labels for x in under) + prior)
        out[r[2]] = ("".join("/" + x for x in merged[r]), p)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_plain_tree(spark, seed):
    r = random.Random(seed)
    urls = []
    for k in range(400):
        host = r.choice(["a.net", "a.net", "a.net", "b.a.net", "x.org", "y.org"])
        path = [r.choice(["en", "de"]), *([f"s{r.randrange(12)}"] if r.random() < 0.7 else []), r.choice([str(r.randrange(90)), f"{r.randrange(90)}.html", "about", "z" * r.randrange(1, 40)])]
        urls.append((k, f"http://{host}/" + "/".join(path[: r.randrange(1, 4)])))
    labels = {k: int(r.random() < (0.9 if "/en/" in u else 0.2)) for k, u in urls if "y.org" not in u and r.random() < 0.4}
    pages = [(u.split("/")[2], tuple(u.split("/")[3:]), k) for k, u in urls]
    want = plain_tree(pages, labels)
    df = spark.createDataFrame([(k, u, "clash", 0) for k, u in urls], "page_id long, url string, host string, pages int")
    got = U.judge_urls(df, spark.createDataFrame(list(labels.items()), "page_id long, bad int")).where("rule IS NULL").collect()
    assert len(got) == 400 and {x.verdict for x in got} == {"allow", "block"}
    for x in got:
        assert x.template == want[x.page_id][0] and x.purity == pytest.approx(want[x.page_id][1], abs=2e-6)
        assert x.verdict == ("block" if x.purity > U.REJECT else "allow")


def test_deep_paths(spark):
    """A path of 300 segments, a loop of growing depth, and forks far down that vary: the plain tree's templates in few rounds."""
    r = random.Random(4)
    paths = [["a"] * n for n in range(1, 40)] + [["deep"] * 3 + [f"k{k}" for k in range(300)]]
    paths += [["x", "y", "z", "u", "v", f"w{r.randrange(3)}", str(r.randrange(900)), r.choice(["p", "q"]), "t" * r.randrange(1, 30)][: r.randrange(5, 10)] for _ in range(150)]
    paths += [["same"] * 5 + [b, "c", d] for b in ("l", "m", "n") for d in ("one", "two") for _ in range(2)]
    pages = [("deep.org", tuple(p), k) for k, p in enumerate(paths)]
    labels = {k: int(r.random() < (0.8 if "w1" in p else 0.1)) for k, p in enumerate(paths) if r.random() < 0.5}
    want = plain_tree(pages, labels)
    df = spark.createDataFrame([(k, "http://deep.org/" + "/".join(p)) for k, p in enumerate(paths)], "page_id long, url string")
    got = U.judge_urls(df, spark.createDataFrame(list(labels.items()), "page_id long, bad int")).collect()
    assert len(got) == len(paths) and any("*" in x.template or "#" in x.template for x in got) and any("+" in x.template for x in got)
    for x in got:
        assert x.template == want[x.page_id][0] and x.purity == pytest.approx(want[x.page_id][1], abs=2e-6)


def test_rules_as_labels(spark):
    """A host most of whose pages a rule blocks loses its other pages too; a host without such pages keeps them; rows may repeat."""
    urls = [f"http://bad.net/es/{k}" for k in range(6)] + ["http://bad.net/en/1", "http://bad.net/en/1", "http://calm.net/en/1", "http://calm.org/en/1", None]
    df = spark.createDataFrame(list(enumerate(urls)) + [(6, urls[6])], "page_id long, url string")
    got = U.judge_urls(df).collect()
    assert len(got) == 12 and {x.page_id for x in got if x.verdict == "block"} == {0, 1, 2, 3, 4, 5, 6, 7}
    assert U.judge_urls(df.where("false")).count() == 0
