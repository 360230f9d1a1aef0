"""Truth tables and plain folds for what SQL does not show."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.context import TenantContext, TenantError
from docloom.functions import scalar as s
from docloom.operators import chunking as ck
from docloom.operators import doctypes as dt
from docloom.operators import evidence as ev
from docloom.operators import extraction as ex
from docloom.operators import lifecycle as lc
from docloom.operators import retrieval as rt
from docloom.operators import structure as st
from docloom.plans import views as v
from docloom.plans.catalog import QUERIES
from docloom.sources import cache, files, publish


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("bad", [None, 0, -1, True, "1", 1.0])
def test_tenant_is_mandatory(bad):
    with pytest.raises(TenantError):
        TenantContext(bad)


def test_empty_trusted_set_is_empty_result(spark):
    docs = spark.createDataFrame([(1, 2)], "id long, tenant_id long")
    rows = spark.createDataFrame([(1, "a")], "document_id long, x string")
    assert TenantContext(1).scope_by_document(rows, docs).count() == 0
    assert TenantContext(2).scope_by_document(rows, docs).count() == 1


@pytest.mark.parametrize(("raw", "expected"), [(" tender ", "tender"), ("tender_doc", "tender"), ("x", "historical_bid"), (None, "historical_bid"), ("regulation", "regulation")])
def test_document_types(spark, raw, expected):
    assert one(spark, dt.normalised_type(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(("asked", "expected"), [(None, list(dt.QA_TYPES)), ([], list(dt.QA_TYPES)), (["tender"], list(dt.QA_TYPES)), (["regulation", "tender", "qualification"], ["qualification", "regulation"]), (["none"], list(dt.QA_TYPES))])
def test_qa_scope_only_narrows(spark, asked, expected):
    assert dt.qa_type_list(asked) == expected
    column = F.lit(None).cast("array<string>") if asked is None else F.array(*map(F.lit, asked)).cast("array<string>")
    assert one(spark, dt.qa_types(column)) == expected


@pytest.mark.parametrize(("raw", "expected"), [('"p. 12"', 12), ('"1-3"', 13), ("7", 7), ("true", None), ('"none"', None), ("1.5", None), (None, None)])
def test_page_number(spark, raw, expected):
    assert one(spark, s.page_number(F.lit(raw).cast("string"))) == expected


def test_versions_and_aliases(spark):
    none = F.lit(None).cast("bigint")
    assert one(spark, s.index_version(none, none)) == 1
    assert one(spark, s.index_version(F.lit(3).cast("bigint"), F.lit(3).cast("bigint"))) == 3
    for a, b in ((2, 3), (0, 0)):
        with pytest.raises(Exception, match="index_version"):
            one(spark, s.index_version(F.lit(a).cast("bigint"), F.lit(b).cast("bigint")))


GUARDS = [
    (None, lc.APPLY), ((1, "ACTIVE", None, None), lc.APPLY), ((1, "ACTIVE", 5, "h"), lc.IDEMPOTENT), ((1, "ACTIVE", 5, "x"), lc.VERSION_MISMATCH), ((1, "ACTIVE", 6, "h"), lc.STALE),
    ((1, "ACTIVE", 4, "h"), lc.APPLY), ((2, "ACTIVE", 5, "h"), lc.REJECT_TENANT), ((1, "DELETED", 5, "h"), lc.REJECT_DELETED), ((1, "QUARANTINED", 1, "h"), lc.REJECT_QUARANTINED), ((2, "DELETED", 5, "h"), lc.REJECT_TENANT),
]


@pytest.mark.parametrize(("guard", "expected"), GUARDS)
def test_decisions(spark, guard, expected):
    requests = spark.createDataFrame([(7, 1, 5, "h")], "document_id long, tenant_id long, index_version long, input_hash string")
    rows = [(7, *guard)] if guard else []
    g = spark.createDataFrame(rows, "document_id long, tenant_id long, lifecycle_status string, current_index_version long, index_input_hash string")
    assert lc.decisions(requests, g).first().decision == expected
    assert lc.fold_requests(guard, [(1, 5, "h", "INGEST")])[1] == [expected]


def test_deletes_are_final():
    state, out = lc.fold_requests(None, [(1, 1, "a", "INGEST"), (1, 1, "a", "DELETE"), (1, 9, "b", "INGEST"), (1, 9, "b", "DELETE"), (2, 9, "b", "DELETE")])
    assert out == [lc.APPLY, lc.APPLY, lc.REJECT_DELETED, lc.IDEMPOTENT, lc.REJECT_TENANT]
    assert state == (1, "DELETED", 1, "a")


def test_merge_in_order_equals_plain_fold_and_stream(spark, sf):
    rows = v.d_request(spark, sf).orderBy("request_id").collect()
    state: dict = {}
    for r in rows:
        state[r.document_id] = lc.fold_requests(state.get(r.document_id), [(r.tenant_id, r.index_version, r.input_hash, r.op)])[0]
    for name in ("guard_merge", "version_stream"):
        got = {r.document_id: (r.tenant_id, r.lifecycle_status, r.current_index_version, r.index_input_hash) for r in QUERIES[name](spark, sf).collect()}
        assert got == state


def plain_pack(parts, limit, joiner):
    out, cur = [], ""
    for p in parts:
        joined = p if not cur else cur + joiner + p
        if len(joined) <= limit:
            cur = joined
        else:
            if cur:
                out.append(cur)
            cur = p
    return out + [cur] if cur else out


def test_greedy_pack_equals_plain_fold(spark, sf):
    rows = v.t(spark, sf, "documents").select("text", ck.greedy_pack(F.split("text", "\n"), 300, "\n").alias("p")).collect()
    assert all(r.p == plain_pack(r.text.split("\n"), 300, "\n") for r in rows)


def test_long_paragraphs_are_split_with_overlap(spark):
    text = "short. " + "x" * 600
    out = one(spark, ck.semantic_split(F.lit(text), 500, 50))
    assert len(out) >= 2 and all(len(p) <= 600 for p in out)
    assert one(spark, ck.semantic_split(F.lit("  a  "), 500, 50)) == ["a"]
    assert one(spark, ck.semantic_split(F.lit(None).cast("string"), 500, 50)) == []


def test_tables_repeat_their_head(spark):
    rows = F.array(F.array(F.lit("h1"), F.lit("h|2")), *(F.array(F.lit("a" * 20), F.lit(str(i))) for i in range(6)))
    out = one(spark, ck.table_chunks(rows, 60))
    assert len(out) > 1 and all(p.startswith("| h1 | h\\|2 |\n| --- | --- |") for p in out)
    assert sum(p.count("a" * 20) for p in out) == 6


def test_document_chunks(spark):
    rows = [(1, 0, "heading", 1, "T", None, 0), (1, 1, "paragraph", None, "one", None, 0), (1, 2, "table", None, "", [["h"], ["c"]], 0), (1, 3, "paragraph", None, "two", None, 0)]
    blocks = st.assign_sections(spark.createDataFrame(rows, files.BLOCKS))
    out = ck.document_chunks(blocks).orderBy("chunk_index").collect()
    assert [(r.chunk_type, r.content) for r in out] == [("paragraph", "one"), ("table", "| h |\n| --- |\n| c |"), ("paragraph", "two")]


def test_trees_with_level_jumps_and_without_headings(spark):
    rows = [(1, p, "heading", lv, f"h{p}", None, 0) for p, lv in enumerate([1, 3, 2, 2, 1, 4, 2])] + [(2, 0, "paragraph", None, "only text", None, 0)]
    blocks = spark.createDataFrame(rows, files.BLOCKS)
    tree = {(r.document_id, r.section_id): r.parent_id for r in st.section_tree(blocks).collect()}
    assert [tree[(1, i)] for i in range(7)] == [None, 0, 0, 0, None, 4, 4]
    assert (2, 0) in tree


def test_fusion_keeps_similarity(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id long, similarity double")
    b = spark.createDataFrame([(2,), (3,)], "id long")
    out = {r.id: (r.similarity, r.score) for r in rt.fuse(a, b).collect()}
    assert out[3][0] is None and out[2] == (0.5, round(1 / 62 + 1 / 61, 9))


def test_code_fences_and_bad_json(spark):
    rows = [('```json\n[{"text": "a", "page": "p 3"}]\n```',), ("nothing",), ('{"text": "b", "page": "4"}',), (None,)]
    out = ex.records(spark.createDataFrame(rows, "answer string"), F.col("answer"), [])
    assert sorted((r.text, r.page) for r in out.collect()) == [("a", 3), ("b", 4)]


def test_stand_in_embeddings_agree(spark, sf):
    rows = QUERIES["embed_distinct"](spark, sf).collect()
    texts = {(r.conv_id, r.turn): r.text for r in v.t(spark, sf, "conversations").collect()}
    e = s.hash_embedding(s.strip(F.col("t")), 64)
    same = spark.createDataFrame([(k[0], k[1], t) for k, t in texts.items()], "conv_id long, turn long, t string").select("conv_id", "turn", F.round(F.get(e, F.lit(0)).cast("float").cast("double"), 6).alias("x"))
    want = {(r.conv_id, r.turn): r.x for r in same.collect()}
    assert all(abs(r.x0 - want[(r.conv_id, r.turn)]) < 2e-6 for r in rows)


def docx(paragraphs, table) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    par = lambda t, style: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' if style else f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(par(t, st_) for t, st_ in paragraphs) + "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{par(c, '')}</w:tc>" for c in r) + "</w:tr>" for r in table) + "</w:tbl>" + par("after", "Heading2")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([("One", "Heading1"), ("text", ""), ("  ", "")], [["x", "y"], ["1", "2"]]))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "c.txt").write_text("plain")
    (tmp_path / "d.zip").write_bytes(b"PK\x03\x04junk")
    found = files.read_binary(spark, str(tmp_path))
    kinds = {r.path.rsplit("/", 1)[1]: r.file_type for r in files.inspect_files(found).collect()}
    assert kinds == {"a.docx": "docx", "b.pdf": "pdf", "c.txt": "txt", "d.zip": None}
    one_file = found.filter("path like '%a.docx'").select(F.lit(1).cast("long").alias("document_id"), F.lit("docx").alias("file_type"), "content")
    rows = files.parse_blocks(one_file).orderBy("pos").collect()
    assert [(r.kind, r.level, r.text) for r in rows] == [("heading", 1, "One"), ("paragraph", None, "text"), ("table", None, ""), ("heading", 2, "after")]
    assert rows[2].rows == [["x", "y"], ["1", "2"]]


def test_publish_flips_all_tables_at_once(spark, tmp_path):
    root = str(tmp_path / "store")
    assert publish.current(spark, root) == {}
    publish.publish(spark, root, {"a": spark.range(3), "b": spark.range(1)})
    publish.publish(spark, root, {"a": spark.range(5)})
    assert publish.read(spark, root, "a").count() == 5 and publish.read(spark, root, "b").count() == 1


def test_cache(spark):
    asked = spark.createDataFrame([("k1",), ("k2",), ("k2",)], "cache_key string")
    kept = spark.createDataFrame([("k1", "old", 1), ("k1", "new", 2)], "cache_key string, answer string, created int")
    assert [r.cache_key for r in cache.misses(asked, kept).collect()] == ["k2"]
    assert {r.answer for r in cache.answered(asked, kept).filter("cache_key = 'k1'").collect()} == {"new"}


def test_queues(spark, tmp_path):
    from docloom.streaming.tasks import run_queues

    rows = [("parse", 1, "a"), ("embed", 2, "b"), ("other", 3, "c"), ("parse", None, "d")]
    spark.createDataFrame(rows, "queue string, document_id long, payload string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("queue string, document_id long, payload string").parquet(str(tmp_path / "in"))
    run_queues(stream, {"parse": lambda d: d, "embed": lambda d: d}, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    count = lambda n: spark.read.parquet(str(tmp_path / "out" / n)).count()
    assert (count("parse"), count("embed"), count("_rejected")) == (1, 1, 2)


def test_jobs_have_one_winner(spark):
    claims = spark.sql("SELECT 1L AS tenant_id, 1L AS document_id, 1L AS index_version, o AS owner_id, timestamp'2024-01-01' AS now FROM VALUES ('a'), ('b') AS t(o)")
    jobs = spark.createDataFrame([], "tenant_id long, document_id long, index_version long, state string, owner_id string, expires_at timestamp")
    out = lc.claim_jobs(claims, jobs).collect()
    assert len(out) == 1 and out[0].owner_id == "a" and out[0].claimed


def test_extraction_keeps_quotes_backslashes_and_line_breaks(spark, tmp_path):
    texts = ['say "x"', "a\\b", "one\ntwo", '\\"\n```json\t[{', "\u00e9 \U0001f600", " plain ", " \n ", ""]
    rows = [(1, i, "user", t) for i, t in enumerate(texts)] + [(1, 99, "assistant", "no")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: (r.item_no, r.text, r.page) for r in QUERIES["llm_extract_stub_all"](spark, str(tmp_path)).collect()}
    assert got == {i: (0, t.strip(), len(t) % 10) for i, t in enumerate(texts) if t.strip()}


def plain_strip(text):
    return text.strip(" \t\n\r\f\v")


def test_strip_takes_white_space_off_both_ends_and_nothing_else(spark):
    texts = ["", " ", " \t\n\r\f\v", "\v a\tb \n", "a \u2028", "a\t\u0085", "\u00a0 a \u00a0", "a \n\u2029", "\na\n\n", "a" + " " * 40 + "b", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", s.strip(F.col("t")).alias("x"))
    assert {r.i: r.x for r in rows.collect()} == {i: None if t is None else plain_strip(t) for i, t in enumerate(texts)}
    # A search from every run of white space costs several times the text.
    assert "regexp" not in rows._jdf.queryExecution().toString()



def plain_overlap(pieces, overlap):
    return [p if i == 0 else pieces[i - 1][-overlap:] + p for i, p in enumerate(pieces)]


def plain_split(text, limit=1200, overlap=150, paragraph=r"\n", joiner="\n"):
    whole = plain_strip(text)
    if len(whole) <= limit:
        return [whole] if whole else []
    out, run = [], []
    for p in filter(None, map(plain_strip, re.split(paragraph, whole))):
        if len(p) <= limit:
            run.append(p)
            continue
        out += plain_pack(run, limit, joiner)
        run = []
        packed = plain_pack([x for x in re.split(r"(?<=[.!?;。！？；])", p) if plain_strip(x)], limit, "")
        cut = [piece for x in packed for piece in ([x] if len(x) <= limit else [x[i : i + limit] for i in range(0, len(x), limit - overlap)])]
        out += plain_overlap(cut, overlap)
    return plain_overlap(out + plain_pack(run, limit, joiner), overlap)


def plain_table(rows, limit=400):
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r) + " |"
    table = lambda rs: "\n".join([line(rs[0]), "|" + " --- |" * len(rs[0]), *map(line, rs[1:])])
    if len(table(rows)) <= limit:
        return [table(rows)]
    size = lambda r: len(" ".join(r))
    groups, cur, n = [], [], size(rows[0])
    for r in rows[1:]:
        if cur and n + size(r) > limit:
            groups.append(cur)
            cur, n = [], size(rows[0])
        cur = [*cur, r]
        n += size(r)
    return [table([rows[0], *g]) for g in ([*groups, cur] if cur else groups)]


def test_chunk_queries_equal_plain_folds(spark, sf, tmp_path):
    made = ["", " \n ", "a|b c\n" + "word " * 200 + "\nd e", "head one\n" + "\n".join("cell " * (i % 9 + 1) for i in range(60)), "x" * 4000 + "\nshort", "First. " * 400 + "\n\n" + "tail; " * 10, "short\n" * 500]
    texts = {i: t for i, t in enumerate(made)} | {r.doc_id + 100: r.text for r in v.t(spark, sf, "documents").collect()}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    digest = lambda p: (len(p), hashlib.sha256(p.encode()).hexdigest())
    for name, at, plain in (("table_row_pack", "part", lambda t: plain_table([x.split(" ") for x in t.split("\n")])), ("chunk_greedy_pack", "chunk_index", plain_split)):
        got = {(r.doc_id, r[at]): (r.n_chars, r.content_hash) for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {(k, i): digest(p) for k, t in texts.items() for i, p in enumerate(plain(t))}


def test_embeddings_read_the_whole_text(spark, tmp_path):
    texts = ["same " * 30 + end for end in ("one", "two")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r[1:] for r in QUERIES["hash_embedding_whole"](spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        raw = [(hashlib.md5(f"{t}:{i}".encode()).digest()[0] - 128) / 128 for i in range(16)]
        assert got[k] == pytest.approx([x / sum(y * y for y in raw) ** 0.5 for x in raw], abs=2e-9)
    assert got[0] != got[1]


def test_groups_are_not_held_as_arrays(spark, sf):
    for name in ("guard_merge", "rag_trace", "pattern_source_rows"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "collect_set" not in plan


def test_merge_starts_from_the_guard(spark):
    state = "document_id long, tenant_id long, lifecycle_status string, current_index_version long, index_input_hash string"
    guard = {1: (1, "ACTIVE", 3, "h"), 2: (2, "DELETED", 1, "x"), 4: (1, "ACTIVE", None, None)}
    asked = [(5, 1, 1, 4, "n", "INGEST"), (4, 1, 1, 2, "o", "INGEST"), (6, 2, 2, 9, "z", "INGEST"), (7, 3, 1, 1, "a", "INGEST"), (8, None, 1, 1, "a", "INGEST")]
    asked += [(100 + i, 7, 1, i // 3, "h", "INGEST") for i in range(25_000)]
    requests = spark.createDataFrame(asked, "request_id long, document_id long, tenant_id long, index_version long, input_hash string, op string")
    got = {r.document_id: tuple(r)[1:] for r in lc.apply_in_order(requests, spark.createDataFrame([(k, *x) for k, x in guard.items()], state)).collect()}
    want = {}
    for d in {r[1] for r in asked} | set(guard):
        end, out = lc.fold_requests(guard.get(d), [r[2:] for r in sorted(asked, key=lambda r: r[0]) if r[1] == d])
        want[d] = (*end, out.count(lc.APPLY), len(out))
    assert got == want


def test_backfill_returns_and_keeps_given_tenants(spark, sf):
    chunks = v.d_chunk(spark, sf, embeddings=False).collect()
    docs = {r.id: r.tenant_id for r in v.d_document(spark, sf).collect()}
    got = [(r.id, r.tenant_id) for r in QUERIES["trusted_backfill_all"](spark, sf).collect()]
    assert sorted(got) == sorted((c.id, docs.get(c.document_id, -1) if c.tenant_id is None else c.tenant_id) for c in chunks)


def test_searches_take_all_stated_queries(spark, sf):
    got = {}
    for r in QUERIES["vector_topk_all"](spark, sf).collect():
        got.setdefault(r.query_id, []).append((-r.similarity, r.id))
    stated = {r.vec_id for r in v.t(spark, sf, "embeddings").filter("vec_id % 50 = 0").collect()}
    assert set(got) == stated and all(len(x) == 10 for x in got.values())
    assert sorted(got[0]) == [(-r.similarity, r.id) for r in QUERIES["vector_topk"](spark, sf).collect()]


def test_many_searches_break_ties_and_drop_zero_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 3.0]), (100, [0.0, 0.0])], "query_id long, query array<double>")
    out = sorted((r.query_id, -r.similarity, r.id) for r in rt.vector_search_many(rows, asked, 2).collect())
    assert out == [(0, -1.0, 1), (0, -1.0, 2), (50, -1.0, 3), (50, 0.0, 1)]


def test_hash_embeddings_are_computed_once(spark):
    rows = spark.range(3).select(F.col("id").cast("string").alias("t"))
    plan = rows.select(s.hash_embedding(F.col("t"), 16).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and plan.count("SQRT(") == 1
    zero = spark.range(1).select(s.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), s.unit(F.lit(None).cast("array<double>")).alias("n")).first()
    assert zero == ([0.0, 0.0], None)


def test_trace_digests_are_of_all_ids_in_order(spark):
    rows = [(k % 3 or None, (k * 7919) % 20_011 - 50) for k in range(30_000)] + [(5, 7), (5, 7), (6, None)]
    hits = spark.createDataFrame(rows, "g long, doc long")
    got = {r.g: (r.n, r.digest) for r in ev.trace_digests(hits, ["g"], "doc").collect()}
    want = {}
    for g in {g for g, _ in rows} - {6}:
        ids = sorted({d for h, d in rows if h == g})
        want[g] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert got == want


def test_a_table_of_many_rows_is_read_once(spark):
    rows = F.transform(F.split("t", "\n"), lambda x: F.split(x, " "))
    lines = ["head of it", *(f"cell {i} " + "x" * (i % 90) for i in range(20_000))]
    df = spark.createDataFrame([("\n".join(lines),), ("one row of a long head " * 30,), ("",)], "t string")
    out = df.select(ck.table_chunks(rows, 400).alias("c"), ck.pack_table(rows, 400).alias("p"))
    assert out.select("c")._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    for (t,), r in zip(df.collect(), out.collect(), strict=True):
        table = [x.split(" ") for x in t.split("\n")]
        assert r.c == plain_table(table)
        assert sum(len(g) - 1 for g in r.p) == len(table) - 1 and all(g[0] == table[0] for g in r.p)
