"""Records, labels, prompts, nested output, queues: nulls, ties, empty tables; blocks to chunks against a plain fold."""

from __future__ import annotations

import hashlib
import itertools
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docloom.functions import scalar as s
from docloom.operators import assembly as asm
from docloom.operators import lifecycle as lc
from docloom.operators import structure
from docloom.plans.catalog import QUERIES
from docloom.sources import files
from docloom.streaming import handlers as hd
from docloom.streaming import tasks
from tests.test_operators import plain_split, plain_table


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def nothing(kind):
    return F.lit(None).cast(kind)


def test_labelled_text(spark):
    fields = {"a": F.lit("x"), "b": nothing("string")}
    assert one(spark, asm.labelled_text(fields, {"l": F.array(F.lit("p"), F.lit("q")), "m": F.array(), "n": nothing("array<string>")})) == "a: x\nb: \nl:\n- p\n- q"


@pytest.mark.parametrize("text, vector", [("[1,2.5]", [1.0, 2.5]), ("[1]", None), ("[1,null]", None), ("no", None), ("", None), (None, None)])
def test_parse_vector(spark, text, vector):
    assert one(spark, asm.parse_vector(F.lit(text).cast("string"), 2)) == vector


def test_real_ids(spark):
    rows = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (3, 2, 5), (4, None, None)], "id long, document_id long, section_id long")
    ids = spark.createDataFrame([(1, 5, 100)], "document_id long, temporary_id long, real_id long")
    out = asm.real_ids(rows, ids)
    assert out.columns == rows.columns
    assert sorted((r.id, r.section_id) for r in out.collect()) == [(1, 100), (2, None), (3, None), (4, None)]


def test_reading_order_takes_null_as_zero(spark):
    rows = spark.createDataFrame([(1, 9, None), (1, 3, 1), (1, 4, -1), (1, 2, 0), (None, 1, None)], "document_id long, id long, sort_order long")
    assert {(r.document_id, r.id): r.place for r in asm.in_reading_order(rows).collect()} == {(1, 4): 1, (1, 2): 2, (1, 9): 3, (1, 3): 4, (None, 1): 1}
    assert sorted(r.id for r in asm.preview(rows, 1).collect()) == [1, 4]
    assert asm.preview(rows.limit(0)).count() == 0


def test_labels(spark):
    got = [one(spark, asm.model_or_rule(F.lit(m).cast("string"), F.lit("rule"), ("a", "b"))) for m in (" A ", "c", "", None)]
    assert got == ["a", "rule", "rule", "rule"]


def test_pattern_records(spark):
    answers = ['{"name": " n ", "type": "B c", "structure": [" x", "", null, "y"]}', '{"name": "m", "structure": {"a": 1}}', '{"name": " "}', "[1]", "{broken", "", None]
    rows = spark.createDataFrame(list(enumerate(answers)), "id long, answer string")
    out = asm.pattern_records(rows, F.col("answer"), ("a", "b_c"), {}, "a").orderBy("id").collect()
    assert [(r.id, r.name, r.type, r.scenario, r.structure) for r in out] == [(0, "n", "b_c", "", ["x", "y"]), (1, "m", "a", "", [])]


def test_prompt_blocks(spark):
    structure = F.array(F.lit("p"), F.lit("q"))
    full = asm.pattern_block(F.lit(2), F.lit("head"), F.lit(3), {"use": F.lit("u"), "none": F.lit("")}, structure, F.lit("abcdef"), 4)
    assert one(spark, full) == "[2] head\nused: 3\nuse: u\nstructure: p / q\ntext:\nabcd..."
    bare = asm.pattern_block(F.lit(1), F.lit("head"), nothing("int"), {"use": nothing("string")}, nothing("array<string>"), nothing("string"))
    assert one(spark, bare) == "[1] head"
    assert one(spark, asm.section_block(F.lit(2), F.lit("1.1"), F.lit("t"), F.lit("k"), F.lit(" body "), 3)) == "  1.1 t (k)\n    > bod..."
    assert one(spark, asm.section_block(nothing("int"), nothing("string"), F.lit("t"), F.lit(""), nothing("string"))) == "t"


def test_nested_json(spark):
    documents = spark.createDataFrame([(1, 'a"b'), (2, None)], "document_id long, name string")
    patterns = spark.createDataFrame([(1, 8), (1, 7), (None, 9)], "document_id long, id long")
    relations = spark.createDataFrame([], "document_id long, source long, target long")
    got = {r.document_id: json.loads(r.json) for r in asm.nested_json(documents, patterns, relations).collect()}
    assert got[1] == {"document": {"document_id": 1, "name": 'a"b'}, "patterns": [{"id": 7}, {"id": 8}], "relations": []}
    assert got[2] == {"document": {"document_id": 2}, "patterns": [], "relations": []}


def test_both_spellings(spark):
    rows = spark.createDataFrame([(1, 2)], "id long, page_start_no long")
    assert asm.both_spellings(rows).first().asDict() == {"id": 1, "page_start_no": 2, "pageStartNo": 2}


def test_totals(spark):
    items = spark.createDataFrame([(1, 2.0), (1, None), (3, 1.0)], "document_id long, score double")
    stats = spark.createDataFrame([(1, 4), (2, 0)], "document_id long, n_blocks long")
    out = {r.document_id: tuple(r[1:]) for r in asm.analysis_summary(items, items, items.limit(0), stats).collect()}
    assert out == {1: (4, 2, 2, 0, 2.0), 2: (0, 0, 0, 0, 0.0)}
    assert {r.name: r.n for r in asm.table_counts(a=items, b=items.limit(0)).collect()} == {"a": 3, "b": 0}


def test_best_stocked(spark):
    documents = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2)], "id long, tenant_id long")
    chunks = spark.createDataFrame([(d, [0.0]) for d in (1, 2, 2, 3, 3, 3, 4)] + [(1, None)] * 5, "document_id long, embedding array<double>")
    sections = spark.createDataFrame([(1,), (2,), (3,), (4,)], "document_id long")
    patterns = spark.createDataFrame([(7, 1, "f"), (8, 2, "f"), (9, 1, None)], "id long, tenant_id long, fingerprint string")
    sources = spark.createDataFrame([(7, 1), (7, 2), (8, 3), (9, 3), (7, 4)], "pattern_id long, document_id long")
    got = asm.best_stocked(documents, chunks, sections, sources, patterns)
    assert [tuple(r) for r in got.select("tenant_id", "document_id", "n_embedded").collect()] == [(1, 2, 2)]


def test_scalars(spark):
    assert one(spark, s.code("SP", F.lit(7))) == "SP007" and one(spark, s.code("SP", F.lit(1234))) == "SP1234"
    assert s.mask_url("db://user:secret@host/x") == "db://user:***@host/x" and s.mask_url("db://host/x") == "db://host/x"
    assert [one(spark, files.reading_order(F.lit(0), F.lit(y))[0]) for y in (10, 30, 31)] == [0.0, 2.0, 2.0]


def test_checked(spark):
    rows = spark.createDataFrame([("PENDING",), ("odd",)], "state string")
    assert lc.checked(rows.limit(1), "state", lc.JOB_STATES).count() == 1
    with pytest.raises(PySparkException, match="state not allowed: odd"):
        lc.checked(rows, "state", lc.JOB_STATES).collect()


def test_broken_files_are_error_rows(spark):
    made = [(1, "docx", b"no archive"), (2, "html", b"<p>fine</p>"), (3, "pdf", b"%PDF"), (4, "html", None)]
    got = {r.document_id: (r.kind, r.text) for r in files.parse_blocks(spark.createDataFrame(made, "document_id long, file_type string, content binary")).collect()}
    assert got[2] == ("paragraph", "fine") and got[3] == ("error", "no parser") and got[4] == ("error", "no content")
    assert got[1][0] == "error" and got[1][1].startswith("BadZipFile")


def test_queues(spark, tmp_path):
    sent = [("parse", 1, "a"), ("parse", 9, "a"), ("embedding", 1, "x"), ("embedding", 1, "x"), ("embedding", 2, "x"), ("analysis", 1, '[{"text": "t"}]'), ("analysis", 1, "no json"), ("other", 1, "x"), ("parse", None, "x"), ("parse", 1, None), (None, 1, "x")]
    spark.createDataFrame(sent, tasks.MESSAGE).write.parquet(str(tmp_path / "in"))
    blocks = spark.createDataFrame([(1,), (1,), (2,)], "document_id long")
    chunks = spark.createDataFrame([(1, 10, "c"), (2, 20, "c"), (1, 11, None)], "document_id long, id long, content string")
    guard = spark.createDataFrame([(1, "ACTIVE"), (2, "DELETED")], "document_id long, lifecycle_status string")
    queues = {"parse": hd.parse_handler(blocks), "embedding": hd.embedding_handler(chunks, guard, 4), "analysis": hd.analysis_handler()}
    out = str(tmp_path / "out")
    tasks.run_queues(spark.readStream.schema(tasks.MESSAGE).parquet(str(tmp_path / "in")), queues, out, str(tmp_path / "log")).awaitTermination()
    rows = lambda name: spark.read.parquet(f"{out}/{name}").collect()
    assert [(r.document_id, r.n_blocks) for r in rows("parse")] == [(1, 2)]
    assert sorted(r.id for r in rows("embedding")) == [10, 11]
    assert [(r.document_id, r.text) for r in rows("analysis")] == [(1, "t")]
    assert len(rows("_rejected")) == 4


def plain_document(text):
    """(section, kind, content) of a document's chunks, as the view makes its blocks."""
    section, run, out = 0, [], []
    heads = -1

    def flush():
        if run:
            out.extend((section, "paragraph", c) for c in plain_split("\n\n".join(run), paragraph=r"\n[ \t\n\r\f\v]*\n", joiner="\n\n"))
            run.clear()

    for pos, line in enumerate(text.split("\n")):
        if pos % 4 == 0:
            flush()
            heads += 1
            section = max(heads, 0)
        elif pos % 11 == 5:
            flush()
            out.extend((section, "table", c) for c in plain_table([[w] for w in line.split(" ")], 1200))
        else:
            run.append(line)
    flush()
    return out


def test_blocks_to_chunks_equal_a_plain_fold(spark, sf, tmp_path):
    made = ["", "\n\n\n", "h\n" + "word " * 600 + "\n" + "First. " * 300 + "\nlast\nh\n" + "cell " * 500 + "\nafter", "h\n" + "x" * 4000, "h\nsame\nsame\nsame\nh\nsame\nsame"]
    texts = {i: t for i, t in enumerate(made)}
    texts |= {r.doc_id + 100: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(tuple(r) for r in QUERIES["document_pipeline"](spark, str(tmp_path)).select("document_id", "chunk_index", "section_id", "chunk_type", "content_hash").collect())
    got = {d: [r[2:] for r in g] for d, g in itertools.groupby(rows, lambda r: r[0])}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = {d: [(n, k, digest(c)) for n, k, c in plain_document(t)] for d, t in texts.items()}
    assert got == {d: c for d, c in expected.items() if c}


def test_full_content_of_nulls_and_bare_documents(spark):
    rows = [(1, 0, "paragraph", None, "before"), (1, 1, "heading", 1, "A"), (1, 2, "heading", 2, "B"), (1, 3, "paragraph", None, None), (1, 4, "heading", 2, "C"), (1, 5, "paragraph", None, "c"), (1, 6, "heading", 99, "D"), (1, 7, "image", None, "no"), (1, 8, "heading", 1, "E")]
    rows += [(2, 0, "paragraph", None, "only"), (2, 1, "paragraph", None, ""), (2, 2, "paragraph", None, "text"), (3, 0, "image", None, "no")]
    blocks = spark.createDataFrame(rows, "document_id long, pos int, kind string, level int, text string")
    got = {(r.document_id, r.section_id): r.full_content for r in structure.full_content(blocks, structure.section_tree(blocks)).collect()}
    assert got == {(1, 0): "C\nc", (1, 1): "", (1, 2): "c", (1, 3): "", (1, 4): "", (2, 0): "only\ntext", (3, 0): ""}
    assert structure.full_content(blocks.limit(0), structure.section_tree(blocks.limit(0))).count() == 0
