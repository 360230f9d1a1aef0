"""The opN_ queries against DuckDB where SQL says it, else against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from docloom.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def documents(spark, sf) -> dict:
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    from tests.test_queries import same

    same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def removed_words(docs: dict, window: int) -> dict:
    first: dict = {}
    for k in sorted(docs, key=lambda k: (k is None, k)):
        w = docs[k]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), k)
    out = {}
    for k, w in docs.items():
        gone = set()
        for i in range(len(w) - window + 1):
            f = first[tuple(w[i : i + window])]
            if f is not None and (k is None or f < k):
                gone |= set(range(i, i + window))
        out[k] = gone
    return out


def test_op3(spark, sf):
    docs = {k: WORD.findall(t or "") for k, t in documents(spark, sf).items()}
    want = {k: (len(docs[k]), len(g), hashlib.sha256(" ".join(w for i, w in enumerate(docs[k]) if i not in g).encode()).hexdigest()) for k, g in removed_words(docs, 50).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op3_substring_dedup"](spark, sf).collect()}
    assert got == want


def brute_contamination(docs: dict, items: list[tuple]) -> dict:
    windows: dict = {}
    for name, text in items:
        w = ALNUM.findall(lower(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if name is None else str(name))
    out = {}
    for k, text in docs.items():
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        out[k] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_op4(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in QUERIES["op4_decontaminate"](spark, sf).collect()}
    assert got == brute_contamination(documents(spark, sf), items)
    assert any(r[4] for r in got.values())


def test_op5(spark, sf):
    rows = QUERIES["op5_quality"](spark, sf).collect()
    assert len(rows) == len(documents(spark, sf))
    assert all(0 <= r.score <= 1 for r in rows)


def test_op7(spark, sf):
    import html

    rows = {r.page_id: r for r in QUERIES["op7_html_text"](spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (rows[p.page_id].text, rows[p.page_id].n_chars) == (want, len(want))


def test_op8(spark, sf):
    docs = {k: lower(t).encode().split() for k, t in documents(spark, sf).items()}
    counts: Counter = Counter()
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in docs}
    for k, w in docs.items():
        if not held[k]:
            counts.update([*w, b""])
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op8_gru_scores"](spark, sf).collect()
    model = base = 0.0
    for r in rows:
        w = [*docs[r.doc_id], b""]
        want = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in counts for x in w), n)
        assert math.isclose(r.base_score, want, rel_tol=1e-9)
        if r.held_out:
            model, base = model + r.score, base + r.base_score
    assert model > base


def components(texts: dict) -> dict:
    sets = {}
    for k, t in texts.items():
        w = WORD.findall(lower(t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    where: dict = {}
    parent = {k: k for k in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k in sets:
        shared = Counter(j for g in sets[k] for j in where.get(g, ()))
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[k]) + len(sets[j]) - n):
                a, b = root(j), root(k)
                parent[max(a, b)] = min(a, b)
        for g in sets[k]:
            where.setdefault(g, []).append(k)
    return {k: (len(sets[k]), root(k)) for k in sets}


def test_op9(spark, sf):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op9_jaccard_join"](spark, sf).collect()}
    assert got == components(documents(spark, sf))


def test_op10(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    docs = documents(spark, sf)
    for r in QUERIES["op10_token_counts"](spark, sf).collect():
        text = docs[r.doc_id] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)


def test_pipeline(spark, sf):
    """Each stage's decision against brute force on its own input."""
    import corpus_pipeline as c

    docs = c.table(spark, sf, "documents")
    columns = docs.columns
    kept = []
    for name, stage in c.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = c.materialise(stage(spark, docs, sf), f"test-{name}")
        after = Counter(r.doc_id for r in docs.select("doc_id").collect())
        kept.append(len(after))
        if name == "exact_dedup":
            last = {}
            for k in sorted(before):
                last[before[k]] = k
            assert set(after) == set(last.values())
        elif name == "near_dedup":
            assert set(after) == {k for k, (_, root) in components(before).items() if root == k}
        elif name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(after) == {k for k, r in brute_contamination(before, items).items() if not r[4]}
        elif name == "mix":
            assert set(after) <= set(before) and docs.columns == [*columns, "copy_no"]
        if name != "mix":
            assert docs.columns == columns and max(after.values()) == 1
    assert kept[0] > 0.7 * c.table(spark, sf, "documents").count()
