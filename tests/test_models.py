"""Calls with bounds and retries, relations by sets and blocks, resumable texts, substring search."""

from __future__ import annotations

import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import extraction as ex
from docloom.operators import fanout as fo
from docloom.operators import regeneralise as rg
from docloom.operators import relations as rl
from docloom.operators import substrings as ss
from docloom.operators import trigram as tg
from docloom.plans import models
from docloom.sources import tables as tb
from docloom.sources.publish import Store


def logging_model(folder: str, answer=lambda t: t.upper()):
    def factory():
        import threading
        import uuid

        lock, open_now = threading.Lock(), [0, 0]

        def model(text):
            with lock:
                open_now[0] += 1
                open_now[1] = max(open_now)
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(json.dumps([text, os.getpid(), open_now[0]]))
            time.sleep(0.01)
            try:
                return answer(text)
            finally:
                with lock:
                    open_now[0] -= 1

        return model

    return factory


def calls(folder) -> list:
    return [json.loads(p.read_text()) for p in folder.iterdir()]


def test_fan_out_is_bounded_and_loses_no_row(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def answer(t):
        if t.startswith("bad"):
            raise ValueError(f"no {t}")
        if t.startswith("slow"):
            raise TimeoutError("late")
        return t.upper()

    rows = [(i, None if i % 20 == 7 else f"{'bad' if i % 10 == 3 else 'slow' if i == 11 else 'good'} {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = fo.fan_out(df, F.col("text"), logging_model(str(log), answer), workers=3, tasks=2, tries=3, wait=0.001).collect()
    assert len(got) == 60
    for r in got:
        if r.text is None:
            assert r.answer is None and r.error is None
        elif r.text.startswith("good"):
            assert r.answer == r.text.upper() and r.error is None
        else:
            assert r.answer is None and r.error in (f"ValueError: no {r.text}", "TimeoutError: late")
    made = calls(log)
    assert max(c[2] for c in made) <= 3 and len({c[1] for c in made}) <= 2
    assert sum(c[0].startswith("slow") for c in made) == 3 and len(made) == 57 + 2
    assert fo.answered(df.limit(0).transform(lambda d: fo.fan_out(d, F.col("text"), logging_model(str(log))))).count() == 0


def test_fan_out_keeps_order():
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        out = list(fo.in_order(pool, lambda x: (time.sleep(random.random() / 200), x)[1], list(range(100)), queued=7))
    assert out == list(range(100))


def test_threads_take_items_by_themselves():
    from concurrent.futures import ThreadPoolExecutor

    class Counting(ThreadPoolExecutor):
        handed = 0

        def submit(self, *args):
            self.handed += 1
            return super().submit(*args)

    with Counting(4) as pool:
        assert list(fo.in_order(pool, lambda x: x * 2, list(range(5000)), 4)) == list(range(0, 10000, 2))
        assert pool.handed <= 4
        assert list(fo.in_order(pool, str, [], 4)) == []


def test_retries():
    tried = []

    def fails(times, error):
        tried.append(1)
        if len(tried) <= times:
            raise error
        return "done"

    assert ex.retried(lambda: fails(2, TimeoutError()), wait=0.001) == "done" and len(tried) == 3
    tried.clear()
    with pytest.raises(ConnectionError):
        ex.retried(lambda: fails(9, ConnectionError()), wait=0.001)
    assert len(tried) == 3
    tried.clear()
    with pytest.raises(ValueError):
        ex.retried(lambda: fails(9, ValueError()), wait=0.001)
    assert len(tried) == 1


def test_a_failing_prompt_does_not_take_its_batch_along(spark):
    def factory():
        def model(texts):
            if any(t == "bad" for t in texts):
                raise ValueError("bad")
            return [t + "!" for t in texts]

        return model

    df = spark.createDataFrame([("a",), ("bad",), ("b",)], "t string").coalesce(1)
    assert [r.answer for r in ex.complete(df, F.col("t"), factory).collect()] == ["a!", None, "b!"]


def plain_relations(sets: dict, model, block: int, whole: int) -> set:
    def ask(group):
        try:
            data = json.loads(model(json.dumps([{"code": c, "name": n, "summary": s[:120]} for c, n, s in group])))
        except (ValueError, TimeoutError):
            return None
        rows = data.get("relations", []) if isinstance(data, dict) else data
        codes = {c for c, _, _ in group}
        return [(r["source"], r["target"], r.get("rel_type") if r.get("rel_type") in ex.RELATIONS else "related") for r in (rows if isinstance(rows, list) else []) if r.get("source") in codes and r.get("target") in codes and r["source"] != r["target"]]

    out = {}
    for doc, group in sets.items():
        if len(group) < 2:
            continue
        edges = ask(group) if len(group) <= whole else None
        if edges is None:
            edges = [e for i in range(0, len(group), block) if len(group[i : i + block]) > 1 for e in ask(group[i : i + block]) or []]
        for s, t, k in edges:
            out.setdefault((doc, s, t), k)
    return {(*key, k) for key, k in out.items()}


def odd_model():
    def model(prompt):
        items = json.loads(prompt)
        codes = [i["code"] for i in items]
        if any(i["summary"] == "fail" for i in items) and len(items) > 1:
            raise TimeoutError("late")
        if items[0]["summary"] == "garbage":
            return "no json"
        if items[0]["summary"] == "words":
            return '"only words"'
        rng = random.Random(json.dumps(items))
        edges = [{"source": rng.choice(codes), "target": rng.choice([*codes, "X"]), "rel_type": rng.choice([*ex.RELATIONS, "odd"])} for _ in range(2 * len(codes))]
        return "```json\n" + json.dumps({"relations": edges} if len(codes) % 2 else edges) + "\n```"

    return model


def test_relations_equal_a_plain_fold(spark, tmp_path):
    rng = random.Random(3)
    sets = {d: [(f"SP{i:03d}", f"n{i}", rng.choice(["a", "b", "c", "d", "fail", "garbage", "words", "é\n\"q\""])) for i in range(n)] for d, n in enumerate([0, 1, 2, 3, 8, 9, 16, 17, 25, 40, 5, 7, 4, 33])}
    rows = [(d, i, c, n, s) for d, group in sets.items() for i, (c, n, s) in enumerate(group)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "document_id long, at int, code string, name string, summary string")
    store = Store(spark, str(tmp_path / "store"))
    got = [tuple(r) for r in rl.extract_relations(df, ["at"], odd_model, store.keep, whole=30).collect()]
    plain = odd_model()
    unfenced = lambda p: plain(p).removeprefix("```json\n").removesuffix("\n```")
    assert len(got) == len(set(got)) and set(got) == plain_relations(sets, unfenced, 8, 30)


def test_buckets_of_a_run_are_published_together(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    store = Store(spark, str(tmp_path / "store"), 4)
    rows = [(i, 1, "p", f"f{i}", f"text {i}") for i in range(40)]
    start = store.publish({"pattern": tb.fitted(spark.createDataFrame(rows, "id long, tenant_id long, name string, fingerprint string, content string"), tb.PATTERN)}, tb.TABLES)
    done = rg.fill(store, "pattern", tb.PATTERN, "content", "generalized_content", logging_model(str(log), str.upper), "a")
    assert (done.sent, done.filled, done.buckets, done.version.number) == (40, 40, 4, start.number + 1)
    assert {r.id: r.generalized_content for r in store.read("pattern", store.pin(), tb.PATTERN).collect()} == {i: f"TEXT {i}" for i in range(40)}
    assert sorted(c[0] for c in calls(log)) == sorted(f"text {i}" for i in range(40))


def test_a_broken_run_goes_on_without_asking_twice(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def answer(t):
        if "fail" in t:
            raise ValueError("no")
        return "" if t == "blank" else f"general {t}"

    store = Store(spark, str(tmp_path / "store"), 4)
    texts = [f"text {i}" for i in range(30)] + ["fail 1", "blank", None, "  "]
    rows = [(i, 1, "p", f"f{i}", t, "had one" if i % 9 == 0 else None) for i, t in enumerate(texts)]
    store.publish({"pattern": tb.fitted(spark.createDataFrame(rows, "id long, tenant_id long, name string, fingerprint string, content string, generalized_content string"), tb.PATTERN)}, tb.TABLES)
    model = logging_model(str(log), answer)
    fill = lambda run, **more: rg.fill(store, "pattern", tb.PATTERN, "content", "generalized_content", model, run, **more)
    first = fill("a", most_buckets=2)
    assert first.buckets == 2
    # Someone fills a row that is still open.
    at = store.pin()
    open_row = store.read("pattern", at, tb.PATTERN).filter("generalized_content IS NULL AND content LIKE 'text%'").orderBy("id").first()
    changed = store.read("pattern", at, tb.PATTERN).withColumn("generalized_content", F.when(F.col("id") == open_row.id, "by hand").otherwise(F.col("generalized_content")))
    store.publish({"pattern": changed}, tb.TABLES)
    second = fill("a")
    assert second.buckets == 2 and fill("a").sent == 0
    got = {r.id: r.generalized_content for r in store.read("pattern", store.pin(), tb.PATTERN).collect()}
    want = {i: "had one" if i % 9 == 0 else "by hand" if i == open_row.id else f"general {t}" if t and t.startswith("text") else None for i, t in enumerate(texts)}
    assert got == want
    asked = [c[0] for c in calls(log)]
    assert len(asked) == len(set(asked)) == first.sent + second.sent
    assert [r.error for r in store.read("pattern_failure", store.pin(), rg.FAILURE).collect()] == ["ValueError: no"]
    again = fill("b")
    assert (again.sent, again.filled, again.blank, again.failed) == (2, 0, 1, 1)


def test_substrings_equal_a_scan(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcAB éß%_\\\n") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "ab%c", "x" * 5000 + "needle"]
    words = [t[i : i + n] for t in texts[:60] for i, n in ((2, 1), (3, 3), (5, 6))] + ["", "zzz", "NEEDLE", None, "%", "b%c", "éß"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    asked = spark.createDataFrame(list(enumerate(words)), "word_id long, word string")
    index = tg.build(df, block=64)
    got = {tuple(r) for r in tg.search(asked, df, index).collect()}
    assert got == {(w, i) for w, word in enumerate(words) for i, t in enumerate(texts) if word is not None and t is not None and word.lower() in t.lower()}
    wild = spark.createDataFrame([(0, "a%b"), (1, "a_b"), (2, "abc")], "word_id long, word string")
    found = {tuple(r) for r in tg.search(wild, df, index, wildcards=True).collect()}
    scan = {(r.word_id, r.id) for r in df.crossJoin(wild).filter(F.expr("content ILIKE concat('%', word, '%')")).collect()}
    assert found == scan and scan


def test_candidates_are_few(spark):
    df = spark.createDataFrame([(i, f"common text number {i} end") for i in range(500)], "id long, content string")
    words = spark.createDataFrame([(0, "number 123 "), (1, "common text")], "word_id long, word string")
    index = tg.build(df)
    n = {r.word_id: r["count"] for r in tg.candidates(words, index).groupBy("word_id").count().collect()}
    assert n[0] <= 5 and n[1] == 500


def test_search_shuffles_no_postings_and_counts_equal_words_once(spark, tmp_path):
    texts = {i: f"line of {i % 7} the\nthe end\n{'ÄB' * (i % 3)}" for i in range(0, 400)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("doc_id", "text", "'src1' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    made = models.substring_search(spark, str(tmp_path))
    lines = {k * 100000 + p: x.lower() for k, t in texts.items() for p, x in enumerate(t.split("\n"))}
    want = {}
    for k in range(0, 400, 50):
        word = (texts[k][4:13] if k % 100 else "line").lower()
        hits = [i for i, x in lines.items() if word in x]
        want[k] = (len(hits), min(hits), max(hits))
    assert {r.word_id: tuple(r)[1:] for r in made.collect()} == want
    df = spark.createDataFrame(list(lines.items()), "id long, content string")
    words = spark.createDataFrame([(k, w) for k, w in enumerate(["the", "ne of 3 t", "äb", "e"] * 20)], "word_id long, word string")
    found = tg.search(words, df, tg.build(df, block=50), word_chars=60)
    assert found.count() == 20 * sum(w in x for w in ("the", "ne of 3 t", "äb", "e") for x in lines.values())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_postings_of_large_alphabets_equal_those_of_small_ones(spark):
    texts = ["".join(chr(0x100 + (i * 37 + j * 11) % 3000) for j in range(50)) for i in range(40)] + ["", "ab", "\U0010ffff" * 4]
    codes, ends, places = tg._postings(texts)
    got = {c: set(places[a:b].tolist()) for c, a, b in zip(codes.tolist(), [0, *ends[:-1]], ends, strict=True)}
    want = {}
    for p, t in enumerate(texts):
        for k in range(len(t) - 2):
            want.setdefault(ord(t[k]) << 42 | ord(t[k + 1]) << 21 | ord(t[k + 2]), set()).add(p)
    assert got == want and list(codes) == sorted(want)
    few = ["".join(map(chr, range(0x20000, 0x20000 + 60_000)))] + [""] * 60_000
    codes, ends, places = tg._postings(few)
    assert len(codes) == len(places) == 59_998 and not places.any() and (np.diff(codes) > 0).all()


def test_totals_equal_a_scan(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abAé\0ß\n𝒳") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "x" * 5000 + "needle", "a" * 70]
    ids = [None if k % 17 == 0 else k * 7 % 311 for k in range(len(texts))]
    words = [t[i : i + n] for t in texts[:80] for i, n in ((0, 1), (2, 2), (3, 3), (1, 4), (3, 7), (0, 8), (2, 9), (5, 13), (1, 30))]
    words += [*words[:9], "", "zzz", "NEEDLE", None, *("a" * n for n in range(1, 72))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "id long, content string").repartition(3)
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    want = {}
    for word in {w.lower() for w in words if w is not None}:
        hits = [i for i, t in zip(ids, texts, strict=True) if t is not None and word in t.lower()]
        own = [i for i in hits if i is not None]
        if hits:
            want[word] = (len(hits), min(own, default=None), max(own, default=None))
    for size in (ss.WORD_BYTES, 4000):
        assert {r.word: tuple(r)[1:] for r in ss.totals(asked, df, size).collect()} == want
    assert ss.totals(asked.filter("false"), df).count() == ss.totals(asked, df.filter("false")).count() == 0


def test_matcher_finds_words_in_pieces_and_with_equal_hashes(monkeypatch):
    monkeypatch.setattr(ss, "BLOCK", 16)
    monkeypatch.setattr(ss.Matcher, "_hash", lambda self, eight, at, n: np.full(len(at), 7, np.uint64))
    rng = random.Random(10)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice((0, 5, 40, 200)))).encode() for _ in range(60)]
    words = sorted({t[i : i + n] for t in texts for i, n in ((0, 1), (3, 5), (1, 8), (2, 9), (4, 17), (0, 33))} - {b""})
    matcher = ss.Matcher(np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    word, text = matcher.find(ss._padded(data), np.cumsum([len(t) for t in texts]))
    got = list(zip(word.tolist(), text.tolist(), strict=True))
    assert got == [(w, t) for w in range(len(words)) for t in range(len(texts)) if words[w] in texts[t]]


def test_time_of_a_search_does_not_grow_with_the_number_of_words(spark):
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(1 << 20)).encode()
    ends = np.arange(256, len(text) + 1, 256)
    data, took = ss._padded(np.frombuffer(text, np.uint8)), []
    for n in (400, 40_000):
        words = sorted({text[i : i + 9] for i in rng.sample(range(len(text) - 9), n)})
        matcher = ss.Matcher(np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words]))
        began = time.process_time()
        word, _ = matcher.find(data, ends)
        took.append(time.process_time() - began)
        assert len(np.unique(word)) > 0.9 * n
    assert took[1] < 12 * took[0] + 0.1
    # A row for each word and task comes back, not one for each word and text.
    df = spark.createDataFrame([(i, f"line of {i % 7} the end") for i in range(3000)], "id long, content string").repartition(2)
    asked = spark.createDataFrame([("line",), ("the end",), ("of 3 ",)], "word string")
    assert ss._pass(asked, df).count() <= 6 and ss.totals(asked, df).agg(F.sum("n")).first()[0] > 6000


def test_substring_search_with_equal_ids_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(50, "some words\nand more words"), (50, "abc the words and the"), (50, "some words\nand more words"), (100, "The end"), (100, "the end"), (150, None), (200, "12 34"), (250, "abcd"), (None, "the end words"), (-50, "Words and the"), (7, "")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'src1' AS source").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    made = models.substring_search(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(models.q.ORACLE_SQL["substring_search"]).fetchall()
    assert sorted(map(tuple, made.collect())) == sorted(want) and len(want) == 5
