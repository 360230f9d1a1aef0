"""Operators 11 to 13: brute force, parameters that force the other way, and tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import ball_tree, host_rules, spelling
from docloom.llm.queries import QUERIES

# --- 11


def brute_clusters(rows: list, k: int, rounds: int, seed: int) -> dict:
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    at = [list(v) for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(at))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        at = [[sum(col) // len(own[n]) for col in zip(*own[n], strict=True)] if own[n] else c for n, c in enumerate(at)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = Counter()
    for _, d, n in found:
        total[n] += d
    return Counter((i, n, d, total[n], total.total(), hashlib.sha256(",".join(map(str, at[n])).encode()).hexdigest()) for i, d, n in found)


def clusters(df, **options) -> Counter:
    return Counter(tuple(r) for r in ball_tree.cluster(df, **options).collect())


def test_op11_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in QUERIES["op11_ball_tree"](spark, sf).collect()) == brute_clusters(rows, 40, 5, 2)


def test_clusters_odd_rows(spark):
    rng = np.random.default_rng(5)
    same = [0.25] * 64
    rows = [(i, same) for i in range(120)] + [(i, rng.normal(size=64).tolist()) for i in range(120, 160)] + [(7, same), (None, [1.0] * 64), (200, [600.0] * 64), (201, [-600.5] * 64)]
    odd = [(300, None), (301, []), (302, [1.0] * 63), (303, [None] + [1.0] * 63), (304, [float("nan")] + [0.0] * 63), (305, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows + odd], "vec_id long, embedding array<double>, cluster string, id string").repartition(3)
    want = brute_clusters(rows, 6, 3, 2)
    assert clusters(df, k=6, rounds=3) == want
    beyond = spark.createDataFrame([(900, [1e30] * 64)], "vec_id long, embedding array<double>")
    got = clusters(df.select("vec_id", "embedding").union(beyond), k=6, rounds=3)
    assert got == want + Counter([(900, None, None, None, None, None)])
    assert clusters(df.limit(0)) == Counter()
    few = spark.createDataFrame([(1, [0.0] * 64), (2, [1.0] * 64)], "vec_id long, embedding array<float>")
    assert clusters(few) == brute_clusters([(1, [0.0] * 64), (2, [1.0] * 64)], 40, 5, 2)


@pytest.mark.parametrize("scale", [200, 1 << 25])
def test_ball_tree_is_exact(scale):
    rng = np.random.default_rng(scale)
    points = rng.integers(-scale, scale, (700, 64)) // 3
    points[rng.integers(0, 700, 300)] = points[0]
    tree, order = ball_tree.BallTree.grow(points, leaf=8)
    tree = ball_tree.BallTree.unpacked(tree.packed())
    centroids = np.concatenate([points[:9], points[:2]])  # equal centroids: the smaller number wins
    square = ((points[order][:, None, :] - centroids[None]) ** 2).sum(2)
    label, off = tree.labels(centroids)
    assert (label == square.argmin(1)).all() and (off == square.min(1)).all()
    n, total = tree.sums(centroids)
    assert (n == np.bincount(square.argmin(1), minlength=11)).all()
    assert all((total[c] == points[order][label == c].sum(0)).all() for c in range(11))


def test_near_balls_go_whole():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-900, 900, (5, 64))
    points = centroids[rng.integers(0, 5, 2000)] + rng.integers(-3, 4, (2000, 64))
    tree, _ = ball_tree.BallTree.grow(points)
    compared = sum(len(tree.within(balls)) for balls, c in tree.assign(centroids) if c is None)
    # Only leaves that a median cut between two groups has mixed are compared vector by vector.
    assert compared <= 4 * ball_tree.LEAF_VECTORS


# --- 12


def brute_variants(docs: list, error_rate: int = 199) -> dict:
    n: Counter = Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % error_rate == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: {v for v in words if abs(len(v) - len(w)) <= 1 and one_error(w, v)} for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def one_error(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def variants(df, **options) -> dict:
    rows = spelling.group_variants(df, **options).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("options", [{}, {"part_words": 40, "hot_half": 6}], ids=["parts", "hot halves in several parts"])
def test_op12_brute_force(spark, sf, options):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_variants([(r.doc_id, r.text) for r in df.collect()])
    got = variants(df, **options)
    assert got == want and sum(v[0] is not None for v in want.values()) > 3


def test_variants_odd_rows(spark):
    chain = "internet " * 300 + "internat " * 50 + "intercat " * 8 + "intercats " * 5
    texts = [chain, None, "", "ÉCOLEÀÿ " * 6 + "écoleàÿ " * 30, "aaaaaa aaaaaaa aaaaaaaa " * 6, "ab " * 5000, "x" * 50_000 + " ", "abcdef×÷ " * 5 + "abcdef " * 25, chain, "ababababab babababab " * 7]
    rows = [(None if i == 3 else i // 2, t, "w") for i, t in enumerate(texts)] + [(6, "x" * 50_000, "w")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    for rate in (199, 3, 10**9):
        assert variants(df, error_rate=rate) == brute_variants([r[:2] for r in rows], rate)
    assert variants(df, error_rate=10**9)["intercats"][:2] == (None, "intercats")
    assert variants(df, error_rate=10**9)["intercat"][:2] == ("internat", "internet")
    assert variants(df.limit(0)) == {}


def test_automaton_numbers_words():
    words = sorted({"tap", "taps", "top", "tops", "stop", "stops", "spot", "a", ""})
    automaton = spelling.Automaton(words)
    for i, w in enumerate(words):
        state, number = automaton.walk(w)
        assert automaton.final[state] and number == i
    assert automaton.size[0] == len(words)
    assert len({id(s) for s in automaton.known.values()}) < sum(map(len, words))
    for w in [*words, "tip", "stp", "tpos"]:
        assert automaton.one_error(w, 0) == {i for i, v in enumerate(words) if one_error(w, v) and abs(len(w) - len(v)) <= 1}


# --- 13


def brute_measures(text: str | None) -> tuple:
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {i + k for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w))


def test_op13_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in QUERIES["op13_host_rules"](spark, sf).collect()}
    assert got == {k: brute_measures(t) for k, t in docs.items()}


GOOD = " ".join(f"word{i}" for i in range(40))
BAD = "again and again and again and again and again and again and again"


def host_table(spark, rows):
    return spark.createDataFrame([(i, t, h, True) for i, (t, h) in enumerate(rows)], "doc_id long, text string, source string, kept boolean")


@pytest.mark.parametrize("limit", [100, 0], ids=["broadcast", "joined"])
def test_host_verdicts(spark, limit):
    rows = [(BAD, "spam")] * 28 + [(GOOD, "spam")] * 2 + [(GOOD, f"site{i % 9}") for i in range(90)] + [(BAD, f"site{i}") for i in range(5)]
    rows += [(BAD, "small"), (GOOD, "news"), (GOOD, None), (BAD, None), (None, None), ("", "news"), (GOOD, "hot")] + [(GOOD, "hot")] * 100
    got = {r.doc_id: r for r in host_rules.judge(host_table(spark, rows), broadcast_limit=limit).collect()}
    assert len(got) == len(rows)
    failed = [brute_measures(text)[-1] for text, _ in rows]
    n, f = Counter(h for _, h in rows if h), Counter(h for (_, h), x in zip(rows, failed, strict=True) if h and x)
    prior = host_rules.fit_prior(len(n), n.total(), f.total(), sum(x * x for x in n.values()), sum(f[h] ** 2 / n[h] for h in n))
    rejected = {h for h in n if prior.shrunk(f[h], n[h]) > 0.5}
    assert "spam" in rejected and not rejected & {"hot", "news", *(f"site{i}" for i in range(9))}
    for i, (_, host) in enumerate(rows):
        assert got[i].base_failed == failed[i]
        assert got[i].host_rejected == (host in rejected), host
        assert got[i].kept == (not failed[i] and host not in rejected)


def test_shrinking_needs_evidence():
    sizes, failures = [200] * 10 + [2], [10] * 9 + [150] + [2]
    prior = host_rules.fit_prior(11, sum(sizes), sum(failures), sum(n * n for n in sizes), sum(f * f / n for f, n in zip(failures, sizes, strict=True)))
    assert prior.shrunk(2, 2) < 0.7 < prior.shrunk(150, 200) < 0.75
    assert abs(prior.shrunk(150, 200) - 0.75) < abs(prior.shrunk(2, 2) - 1)
    alike = host_rules.fit_prior(2, 20, 10, 200.0, 5.0)
    assert alike.weight == float("inf") and alike.shrunk(10, 10) == 0.5
    assert host_rules.fit_prior(0, 0, 0, 0.0, 0.0).shrunk(0, 1) == 0


def test_measures_odd_rows(spark):
    texts = [None, "", " \t\n", "a b c d e a b c d e", "a a a a a a a", "x\n\nx\n \nx \nx", "é é #|<> é", "w " * 30_000, "long" * 100_000, GOOD + "\n" + GOOD, "\x0b\x0c\r"]
    df = host_table(spark, [(t, "h") for t in texts]).unionAll(host_table(spark, [(GOOD, "h")]))
    got = sorted(tuple(r)[:7] for r in host_rules.measures(df).drop("host").collect())
    want = sorted((i, *brute_measures(t)) for i, t in [*enumerate(texts), (0, GOOD)])
    assert got == want
    assert host_rules.judge(df.limit(0)).collect() == []


def test_windows_with_equal_numbers_are_told_apart(monkeypatch):
    words, counts = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 7, 8, 9, 1, 2]), np.array([13, 3])
    assert host_rules.repeated_words(words, counts).tolist() == [10, 0]
    assert host_rules._repeated_exactly(words[:13], 5) == 10
