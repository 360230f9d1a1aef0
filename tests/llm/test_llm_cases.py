"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import json
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import cotraining, decontaminate, exact_dedup, gru_lm, html_text, jaccard_join, mixing, substring_dedup, token_counts, tool_chat
from docloom.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ident string, copy_no int, _gone int, _id long"
BASE = " ".join(f"word{i}" for i in range(120))
LONG = " ".join(f"long{i % 977}x{i}" for i in range(30_000))


def docs(spark, rows, tmp_path=None, name="d"):
    df = spark.createDataFrame([(k, t, "en", "s", 1, "x", 5, 6, 7) for k, t in rows], DOCS)
    if tmp_path is None:
        return df
    path = str(tmp_path / name)
    df.coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


ODD = [(1, BASE), (2, None), (3, ""), (4, " \n\t "), (5, BASE), (5, BASE), (None, BASE), (6, LONG), (7, BASE + " tail"), (None, None), (8, "one two"), (9, "Ünï çödé 漢字 " * 30)]


def test_exact_dedup_cases(spark, tmp_path):
    rows = exact_dedup.duplicate_groups(docs(spark, ODD, tmp_path)).collect()
    base = [r for r in rows if r.keep_id == 5]
    assert len(rows) == len(ODD) and len(base) == 4 and all(r.group_size == 4 for r in base)
    assert sum(r.kept for r in base) == 1 and next(r for r in base if r.kept).doc_id == 5
    empty = [r for r in rows if r.keep_id == 3]
    assert {r.doc_id for r in empty} == {2, 3, None} and all(r.group_size == 3 for r in empty)
    kept = exact_dedup.keep_last_of_each_text(docs(spark, ODD, tmp_path, "k"))
    assert kept.columns == docs(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 8, 9]


def test_exact_dedup_compares_full_bytes(spark, tmp_path):
    weak = lambda c: F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 1)  # noqa: E731  16 digests only
    rows = [(i, f"text {i % 40}") for i in range(120)]
    out = exact_dedup.duplicate_groups(docs(spark, rows, tmp_path), digest=weak).collect()
    assert all(r.group_size == 3 and r.keep_id % 40 == r.doc_id % 40 and r.keep_id >= 80 for r in out)


def test_exact_dedup_over_many_batches(spark, tmp_path):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    a = docs(spark, rows, tmp_path)
    one, many = (sorted(map(tuple, exact_dedup.duplicate_groups(a, files_per_batch=n).collect())) for n in (None, 1))
    assert one == many


def test_mixing_cases(spark):
    d = docs(spark, [(i, "t") for i in range(3000)]).withColumn("source", F.when(F.col("doc_id") < 2000, "a").when(F.col("doc_id") < 2900, "b"))
    out = mixing.poisson_mix(d, {"a": 1.0, "b": 1.0, None: 2.0}, total=8000)
    assert out.columns == [*d.columns, "_copy_no"]
    n = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["a"] - 2000) < 250 and abs(n["b"] - 2000) < 250 and abs(n[None] - 4000) < 400
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.poisson_mix(d, {"a": 1.0, "b": 1.0, None: 2.0}, total=8000).collect()))
    assert mixing.poisson_mix(d.limit(0)).count() == 0
    assert mixing.poisson_mix(d, {"a": 0.0}, default_weight=0.0).count() == 0


def test_mixing_joins_many_sources_the_same(spark, monkeypatch):
    d = docs(spark, [(i, "t") for i in range(500)]).withColumn("source", (F.col("doc_id") % 20).cast("string"))
    want = sorted(map(str, mixing.poisson_mix(d).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(str, mixing.poisson_mix(d).collect())) == want


def test_substring_cases(spark, tmp_path):
    from tests.llm.test_llm_queries import removed_words

    rows = [*ODD, (10, "a b c " + BASE), (11, BASE[:300] + " x " + BASE), (12, LONG[5000:9000])]
    out = substring_dedup.remove_repeats(docs(spark, rows, tmp_path)).collect()
    assert len(out) == len(rows)
    unique = {k: (t or "").split() for k, t in rows}
    want = removed_words(unique, 50)
    for r in out:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed) == (len(unique[r.doc_id]), len(want[r.doc_id]))
    assert sorted(r.n_removed for r in out if r.doc_id is None) == [0, 120]
    assert substring_dedup.remove_repeats(docs(spark, [], tmp_path, "e")).count() == 0


def test_substring_over_many_buckets(spark, tmp_path, monkeypatch):
    a = docs(spark, [(i, " ".join(f"w{(i % 5) * 1000 + j}" for j in range(200))) for i in range(20)], tmp_path)
    want = sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(a).collect())
    monkeypatch.setattr(substring_dedup, "BUCKET_WORDS", 100)
    monkeypatch.setattr(substring_dedup, "BATCH_WORDS", 300)
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(a).collect())
    assert got == want == [(i, 0 if i < 5 else 200) for i in range(20)]


def test_decontamination_cases(spark, monkeypatch):
    from tests.llm.test_llm_queries import brute_contamination

    items = [("a", BASE), (None, "one two"), ("c", None), ("d", ""), ("e", "tail"), ("a", BASE), ("f", LONG[2000:2300])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [(k, t) for k, t in ODD if k is not None and k != 5] + [(5, BASE)]
    want = brute_contamination(dict(rows), items)
    for size in (decontaminate.BLOCK_CHARS, 500):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", size)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs(spark, rows), bench).collect()}
        assert got == want
    longest = {r.doc_id: r.longest_match for r in decontaminate.contamination(docs(spark, rows), bench).collect()}
    assert longest[1] == 120
    kept = decontaminate.remove_contaminated(docs(spark, rows), bench)
    assert kept.columns == docs(spark, []).columns and {r.doc_id for r in kept.collect()} == {k for k, r in want.items() if not r[4]}
    assert decontaminate.contamination(docs(spark, rows), bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0


def near_copies(n: int) -> list:
    rng = np.random.Generator(np.random.PCG64(3))
    out = []
    for i in range(n):
        size = int(rng.integers(1, 220))
        words = [f"v{rng.integers(0, 4000)}" for _ in range(size)]
        out.append((len(out), " ".join(words)))
        for _ in range(int(rng.integers(0, 3))):
            copy = list(words)
            for _ in range(int(rng.integers(0, max(1, size // 40) + 1))):
                copy[int(rng.integers(0, size))] = f"n{rng.integers(0, 10**6)}"
            out.append((len(out), " ".join(copy)))
    # A passage that many documents share, up to most of their text.
    passage = [f"p{i}" for i in range(80)]
    for i in range(90):
        tail = [f"t{rng.integers(0, 10**6)}" for _ in range(int(rng.integers(1, 90)))]
        out.append((len(out), " ".join(passage + tail)))
    return out


@pytest.mark.parametrize("group", [64, 4])
def test_jaccard_equals_brute_force(spark, tmp_path, monkeypatch, group):
    from tests.llm.test_llm_queries import components

    monkeypatch.setattr(jaccard_join, "GROUP", group)
    monkeypatch.setattr(jaccard_join, "BUCKET_SHINGLES", 3000)
    monkeypatch.setattr(jaccard_join, "BATCH_ENTRIES", 2000)
    rows = near_copies(150)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, rows, tmp_path)).collect()}
    assert got == components(dict(rows))


def most_bytes(work):
    """Most memory that numpy and Python take during ``work``."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_workers_of_near_dedup_and_quality_stay_small():
    rng = np.random.Generator(np.random.PCG64(5))
    words = [b"%x" % w for w in rng.integers(0, 1 << 40, 3000)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 3000, 200)) for _ in range(1000)]
    assert most_bytes(lambda: [0 for _ in jaccard_join.shingle_sets(texts)]) < 20 << 20
    n = 500_000
    entries = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    owner, some = np.sort(rng.integers(0, 2000, n, dtype=np.int32)), np.zeros(1000, dtype=np.int64)
    assert most_bytes(lambda: jaccard_join._pack(0, some, some, some, np.repeat(some, 2), entries, owner, 20)) < 55 * n
    cotraining._slot.cache_clear()
    assert most_bytes(lambda: [cotraining._slot(b"%x" % i) for i in range(100_000)]) < 12 << 20


def test_repeated_numbers_are_found_piece_by_piece():
    rng = np.random.Generator(np.random.PCG64(6))
    low = [rng.choice(np.concatenate([rng.integers(0, 1 << 40, 50), [0, (1 << 40) - 1]]), n) for n in (60, 0, 90)]
    values, times = np.unique(np.concatenate(low), return_counts=True)
    assert np.array_equal(jaccard_join.repeated(low), values[times > 1])
    assert not len(jaccard_join.repeated([low[1]]))


def test_jaccard_cases(spark, tmp_path):
    got = jaccard_join.jaccard_components(docs(spark, ODD, tmp_path)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert by[2] == (0, 2) and by[3] == (0, 3) and by[5] == by[1] == (116, 1) and by[7] == (117, 1) and by[8] == (1, 8)
    kept = jaccard_join.keep_one_per_component(docs(spark, ODD, tmp_path, "k"))
    assert kept.columns == docs(spark, []).columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 8, 9, None}
    assert jaccard_join.jaccard_components(docs(spark, [], tmp_path, "e")).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5)] + [(100, i) for i in range(101, 130)] + [(i, i + 1) for i in range(200, 260)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got[3] == 1 and got[9] == 7 and got[129] == 100 and got[260] == 200 and 5 not in got


def test_token_cases(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [None, "", "don't<|endoftext|>x <|startoftext|> y", "é é   a　b​ ΣΑΣ İ 12a3'll", "x" * 20_000, LONG, "a\x1cb\x85c d"]
    out = token_counts.token_counts(docs(spark, list(enumerate(texts))), path)
    for r in out.collect():
        text = texts[r.doc_id] or ""
        assert (r.n_tokens, r.n_bytes) == (len(t.encode(text, add_special_tokens=False).ids), len(text.encode()))
    assert token_counts.token_counts(docs(spark, []), path).count() == 0
    assert token_counts.token_counts(docs(spark, [(1, "a"), (1, "b c"), (None, None)]), path).count() == 3


def test_language_model_cases(spark):
    out = gru_lm.score_texts(docs(spark, [*ODD, (13, None)])).collect()
    assert len(out) == len(ODD) + 1 and all(np.isfinite(r.score) and r.score < 0 for r in out)
    assert gru_lm.score_texts(docs(spark, [])).count() == 0


def test_language_model_trains_on_all_training_documents(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "TRAIN_TOKENS", 50, raising=False)
    rows, given = [(i, f"word{i % 9} and again") for i in range(300)], []
    real = gru_lm.train
    monkeypatch.setattr(gru_lm, "train", lambda texts, *a, **k: (given.append(texts.count()), real(texts, *a, **k))[1])
    gru_lm.score_texts(docs(spark, rows)).collect()
    assert given == [sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows)]


def test_trainer_blocks_hold_all_tokens(monkeypatch):
    monkeypatch.setattr(gru_lm, "BLOCK_TOKENS", 100)
    texts, sizes = [np.full(n, 5, dtype=np.int32) for n in (30, 60, 20, 400, 1, 99)], []
    real = gru_lm.train_documents
    monkeypatch.setattr(gru_lm, "train_documents", lambda flat, block, rate: (sizes.append(sum(map(len, block))), real(flat, block, rate))[1])
    flat = gru_lm.start_parameters(np.ones(gru_lm.VOCABULARY))
    out, seen = gru_lm.train_blocks(flat, iter(texts), 0.01)
    assert (seen, sizes) == (610, [90, 20, 400, 100]) and not np.array_equal(out, flat)
    assert gru_lm.train_blocks(flat, iter([]), 0.01)[1] == 0


def test_training_leaves_out_lanes_past_their_end(monkeypatch):
    texts, cells = [np.full(n, 5, dtype=np.int32) for n in (2000, *[100] * 18)], []
    real = gru_lm._forward
    monkeypatch.setattr(gru_lm, "_forward", lambda p, x, *rest: (cells.append(x.size), real(p, x, *rest))[1])
    flat = gru_lm.start_parameters(np.ones(gru_lm.VOCABULARY))
    out, seen = gru_lm.train_documents(flat, texts, 0.01)
    assert seen == 3800 and seen <= sum(cells) < 1.1 * seen and np.isfinite(out).all()
    # A trainer's lanes are as full as a block's.
    assert gru_lm.TRAINER_TOKENS >= gru_lm.BLOCK_TOKENS


def test_network_gradients():
    rng = np.random.Generator(np.random.PCG64(1))
    flat = (gru_lm.start_parameters(np.ones(gru_lm.VOCABULARY)) + rng.standard_normal(sum(int(np.prod(s)) for s in gru_lm._shapes().values())) * 0.1).astype(np.float64)
    p = gru_lm.unpack(flat)
    x, y = rng.integers(0, 50, (5, 3)), rng.integers(0, 1000, 15)
    starts = np.zeros((5, 3), dtype=bool)
    starts[0] = True
    starts[3, 1] = True
    h = np.zeros((3, gru_lm.HIDDEN))

    def loss():
        states, _, _ = gru_lm._forward(p, x, starts, h)
        return -gru_lm._softmax_parts(p, states.reshape(-1, gru_lm.HIDDEN).astype(np.float64), y, None)[0].sum()

    states, _, cache = gru_lm._forward(p, x, starts, h)
    g = np.zeros_like(flat)
    grads = gru_lm.unpack(g)
    _, dh = gru_lm._softmax_parts(p, states.reshape(-1, gru_lm.HIDDEN).astype(np.float64), y, grads)
    gru_lm._backward(p, x, starts, cache, dh.reshape(states.shape), grads)
    for i in rng.choice(np.flatnonzero(np.abs(g) > 1e-2), 25, replace=False):
        keep = flat[i]
        flat[i] = keep + 1e-3
        up = loss()
        flat[i] = keep - 1e-3
        down = loss()
        flat[i] = keep
        assert abs((up - down) / 2e-3 - g[i]) < 2e-2 * max(1, abs(g[i]))


def test_scores_do_not_depend_on_lanes():
    rng = np.random.Generator(np.random.PCG64(2))
    flat = gru_lm.start_parameters(np.arange(gru_lm.VOCABULARY, 0, -1.0))
    texts = [np.append(rng.integers(2, 500, n), gru_lm.END).astype(np.int32) for n in (0, 1, 30, 200, 5, 77)]
    together = gru_lm.document_scores(flat, texts, 2)
    assert np.allclose(together, [gru_lm.document_scores(flat, [t])[0] for t in texts], rtol=1e-4)


def test_quality_cases(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    word = lambda: f"w{rng.integers(0, 500)}"
    rows = [(i, " ".join(word() for _ in range(60)) + ("." if i % 4 else " idiot" if i % 8 else " !! ## !!" * 10)) for i in range(400)]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 8 != 0), int(i % 8 == 4)) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.rejected for r in cotraining.quality_scores(d, labels).collect()}
    held = [i for i in range(300, 400)]
    assert np.mean([got[i] == (i % 4 == 0) for i in held]) > 0.9
    kept = cotraining.keep_good(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, bad in got.items() if not bad}
    odd = docs(spark, ODD)
    for some in (labels.limit(0), labels.filter("quality = 1 AND toxic = 0")):
        assert cotraining.quality_scores(odd, some).filter("rejected").count() == 0
    assert cotraining.quality_scores(odd.withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long")), labels).count() == len(ODD)
    assert cotraining.quality_scores(docs(spark, []), labels).count() == 0


def test_templates_and_boilerplate(spark):
    page = "<html><head><title>x</title></head><body><div class='box'><b>Buy</b> now</div><header>Site</header><nav><ul><li>m</ul></nav><article><header><h1>T{i}</h1></header><p>Text&nbsp;{i} &amp; more<br>line<div class='cookie-notice'>ok?</div><section><div>Same inner</div></section><p>Same para<aside>side</aside><form>f</form><script>var a='</p>';</script></article><section id=comments><article>me too</article></section><footer>&copy;</footer></body>"
    rows = [(i, f"https://H.example:80/{i}", page.replace("{i}", str(i))) for i in range(12)] + [(None, None, None), (50, "x", "<p>a<b>c</p>< 3 & d"), (51, "https://other.example/", page.replace("{i}", "z"))]
    q = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_texts(q).collect()}
    assert got[3] == "T3\nText 3 & more line\nSame para"
    assert got[51] == "Tz\nText z & more line\nSame inner\nSame para"
    assert got[None] == "" and got[50] == "ac\n< 3 & d"
    assert {r.page_id: r.text for r in html_text.main_texts(q, broadcast_limit=0).collect()} == got
    assert html_text.main_texts(q.limit(0)).count() == 0


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, kind string, role string, call_id string, name string, arguments string, uses array<string>, text string")


def test_broken_pages_take_linear_time():
    long = 60_000
    broken = ["<a " * long, '<a ">" ' * long, "<a b=\"'>" * long, "<b>" * long + "</i>" * long, "<b>" * long + "<hr>" * long, "<b>" * long + "<option>" * long, "<script>" + "</script" * long, "<!" * long, "<!--" * long]
    start = time.monotonic()
    for source in broken:
        page = html_text.Page(source)
        page.subtree_hashes()
        page.main_text(set())
    assert time.monotonic() - start < 60
    assert html_text.Page("a<p title='x>y'>b<p \">c</p>").main_text(set()) == "a\nb\nc"
    assert html_text.Page("<ul><li>a<b>b<li>c</ul><table><tr><td>d<th>e<tr><td>f</table>g<!--h").main_text(set()) == "ab\nc\nd\ne\nf\ng"


def test_tool_chat_cases(spark):
    schemas = spark.createDataFrame([("f", "a", "integer", True), ("f", "b", "string", False), ("g", "x", "object", True)], "name string, param string, type string, required boolean")
    rows = [
        (1, 0, "call", "assistant", "c0", "f", '{"b":"x","a":1}', ["c1"], None), (1, 1, "call", "assistant", "c1", "f", '{"a":"1"}', None, None), (1, 2, "result", "tool", "c0", None, None, None, 'say "hi"'),
        (1, 3, "result", "tool", "c0", None, None, None, "again"), (1, 4, "result", "tool", "zz", None, None, None, "lost"), (1, 5, "text", "user", None, None, None, None, None),
        (2, 0, "call", "assistant", "d0", "f", "{}", ["d1"], ""), (2, 1, "call", "assistant", "d1", "h", "nope", ["d0"], ""), (3, 0, "call", "assistant", "c0", "g", '{"x":{"k":[1]}}', [], ""), (3, 1, "call", "assistant", None, "g", None, [], ""),
    ]
    out = {(r.conv_id, r.turn): r for r in tool_chat.format_tool_chat(messages(spark, rows), schemas).collect()}
    first = out[1, 0]
    assert first.linked and first.level == 1 and first.problems == []
    assert json.loads(first.message) == {"arguments": {"a": 1, "b": "x"}, "call_id": "c0", "name": "f", "result": 'say "hi"', "role": "assistant"}
    assert first.message.startswith('{"arguments":{"a":1,"b":"x"},"call_id"')
    assert out[1, 1].level == 0 and out[1, 1].problems == ["type of a"]
    assert (1, 2) not in out and out[1, 3].problems == ["repeated result"] and out[1, 4].problems == ["orphan"]
    assert out[1, 5].message == '{"content":"","role":"user"}'
    assert out[2, 0].level is None and out[2, 0].problems == ["missing a", "cycle"]
    assert out[2, 1].problems == ["unknown tool", "not an object", "cycle"] and json.loads(out[2, 1].message)["arguments"] == "nope"
    assert out[3, 0].problems == ["repeated id"] and out[3, 1].problems == ["missing x"]
    assert tool_chat.format_tool_chat(messages(spark, []), schemas).count() == 0


@pytest.mark.parametrize("block", [1000, 3])
def test_tool_chat_repeated_rows(spark, monkeypatch, block):
    """N copies of a conversation: every row is there but for the one linked result."""
    schemas = spark.createDataFrame([("f", "a", "integer", True)], "name string, param string, type string, required boolean")
    monkeypatch.setattr(tool_chat, "COPY_BLOCK", block)
    long = "x" * 300_000
    one = [(7, 0, "call", "assistant", "k0", "f", '{"a":1}', [], long), (7, 1, "result", "tool", "k0", None, None, None, long), (7, 2, "call", "assistant", "k1", "f", '{"a":1,"a":2}', ["k0"], ""), (7, 3, "text", "user", None, None, None, None, "t")]
    for n in (1, 2, 40):
        out = tool_chat.format_tool_chat(messages(spark, one * n).withColumn("linked", F.lit(1)).withColumn("first", F.lit(1)), schemas).collect()
        assert len(out) == 4 * n - 1
        linked = [r for r in out if r.linked]
        assert len(linked) == 1 and json.loads(linked[0].message)["result"] == long
        assert sum(r.problems == ["repeated id"] for r in out) == n - 1 and sum(r.problems == ["repeated result"] for r in out) == n - 1
        assert sum("not an object" in r.problems for r in out) == n


def test_tool_chat_null_conversations(spark):
    schemas = spark.createDataFrame([], "name string, param string, type string, required boolean")
    rows = [(None, 0, "call", "a", "c0", "f", None, ["c1"], None), (None, 1, "call", "a", "c1", "f", None, [], None), (None, None, "call", "a", None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    out = {(r.call_id, r.turn, r.kind): r for r in tool_chat.format_tool_chat(messages(spark, rows), schemas).collect()}
    assert len(out) == 4 and out["c0", 0, "call"].level == 1 and out["c1", 1, "call"].level == 0


def test_quality_searches_all_unlabelled_documents(spark, monkeypatch):
    """The same model as when a plain loop over all unlabelled documents chooses the pseudo-labels."""
    monkeypatch.setattr(cotraining, "EXCHANGE", 20)
    rng = np.random.Generator(np.random.PCG64(6))
    rows = [(i, " ".join(f"w{rng.integers(0, 60)}" for _ in range(40)) + (" fine" if i % 3 else " !! ## bad")) for i in range(600)] + [(700, "w1 fine"), (700, "w1 fine"), (None, "bad ## !!")]
    d = docs(spark, rows).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "x").otherwise("y"))
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    features = cotraining.document_features(d)
    plain, known = {}, set(range(90))
    for r in features.collect():
        text = (np.frombuffer(r.slots, dtype=np.int32),) * 2
        plain[r.id] = ((text[0], np.ones(len(text[0]), dtype=np.float32), np.frombuffer(r.dense, dtype=np.float32)), cotraining.meta_features(r.lang, r.source, r.n_chars))
    calls = []

    def loop(classifiers, n_good, n_bad, skip):
        out = []
        for v in (0, 1):
            z = {i: float(classifiers[v].margin([x[v]])[0]) for i, x in plain.items() if i is not None and i not in known and i not in skip}
            order = sorted(z, key=lambda i: (-z[i], i))
            out.append(([(i, *plain[i], z[i]) for i in order[:n_good]], [(i, *plain[i], z[i]) for i in sorted(z, key=lambda i: (z[i], i))[:n_bad]]))
        calls.append(out)
        return out

    search = cotraining.spark_most_confident(features, labels.select(F.col("doc_id").alias("id")))
    target = {i: float(i % 3 != 0) for i in known}
    labelled = [(i, *plain[i], target[i]) for i in sorted(known)]

    def both(classifiers, n_good, n_bad, skip):
        ours, want = search(classifiers, n_good, n_bad, skip), loop(classifiers, n_good, n_bad, skip)
        for x, y in zip(ours, want, strict=True):
            for a, b in zip(x, y, strict=True):
                assert np.allclose([r[3] for r in a], [r[3] for r in b])
        return want

    model = cotraining.co_train(labelled, both)
    assert calls and len(calls) <= cotraining.ROUNDS
    wrong = np.mean([(model.scores([x[0]], [x[1]])[2][0] > 0.5) != (i % 3 != 0) for i, x in plain.items() if i is not None and 90 <= i < 600])
    assert wrong < 0.1
    # Without co-training rounds the combination rests on the labelled documents alone.
    assert cotraining.co_train(labelled, None).text is not None
