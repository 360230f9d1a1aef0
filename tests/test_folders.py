"""Files to blocks to chunks: nothing of a page is lost, broken files do not hurt, heads tell types."""

from __future__ import annotations

import hashlib
import html
import io
import os
import re
import zipfile

from docloom.plans.catalog import QUERIES
from docloom.sources import documents as dc
from docloom.sources import files as fl
from tests.test_assembled import plain_split, plain_table


def bare(text: str) -> str:
    return re.sub(r"\s+", "", text)


def test_every_text_of_a_page_is_in_one_block(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    blocks: dict = {}
    for r in sorted(QUERIES["html_blocks"](spark, sf).collect(), key=lambda r: (r.document_id, r.pos)):
        blocks.setdefault(r.document_id, []).append(r.text)
    for i, source in pages.items():
        plain = re.sub(r"(?is)<(script|style|title)\b.*?</\1>|<!--.*?-->|<!doctype[^>]*>", "", source)
        assert bare("".join(blocks[i])) == bare(html.unescape(re.sub(r"<[^>]*>", "", plain))), i


def test_blocks_of_all_kinds():
    source = "<title>no</title>bare<div>in div</div><h2>H</h2><p>one<ul><li>a<li>b<ul><li>c</ul>after c</ul>after list</p><table><tr><td>x<td>y<p>z</p></tr><tr><th>1</th><td><table><tr><td>n</td></tr></table></td></tr></table><pre>  a\n  b\n</pre><blockquote>q</blockquote>tail<script>no</script><table><tr><td>open"
    got = [(k, level, rows or text) for k, level, text, rows in fl.html_blocks(source)]
    assert got == [
        ("paragraph", None, "bare"), ("paragraph", None, "in div"), ("heading", 2, "H"), ("paragraph", None, "one"), ("list", None, "a"), ("list", None, "b"), ("list", None, "c"), ("list", None, "after c"),
        ("paragraph", None, "after list"), ("table", None, [["x", "y\nz"], ["1", "n"]]), ("paragraph", None, "  a\n  b"), ("paragraph", None, "q"), ("paragraph", None, "tail"), ("table", None, [["open"]]),
    ]
    assert fl.html_blocks("") == [] and fl.text_blocks("a\nb\n \n\nc\n") == [("paragraph", None, "a\nb", None), ("paragraph", None, "c", None)]


def docx(body: str) -> bytes:
    out = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"


def test_a_folder_with_broken_large_and_unknown_files(spark, tmp_path):
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("x.txt", "x")
    table = f"<w:tbl><w:tr><w:tc>{P.format('a')}{P.format('b')}</w:tc><w:tc>{P.format('c')}</w:tc></w:tr></w:tbl>"
    made = {
        "good.html": b"<h1>One</h1><p>text", "no_extension": docx(P.format("word") + table), "broken.docx": b"PK\x03\x04 no zip", "named.docx": b"not a zip at all", "other.docx": other.getvalue(), "paper.pdf": b"%PDF-1.7", "old.xls": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1",
        "empty.html": b"", "large.txt": ("line of text ä\n" * 40_000).encode(), "binary.txt": b"\0\1\2", "sub/deep.md": "a\n\nb".encode(), ".hidden.html": b"<p>no", "cut.txt": b"a" * (dc.HEAD_BYTES - 1) + "ä".encode() + b"b",
    }
    for name, content in made.items():
        os.makedirs(tmp_path / "in" / os.path.dirname(name), exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    root = str(tmp_path / "in")
    listing = {os.path.relpath(r.path, root): (r.size, r.file_type) for r in dc.read_documents(spark, root, blocks=False).collect()}
    kinds = {"good.html": "html", "no_extension": "docx", "broken.docx": None, "named.docx": "docx", "other.docx": None, "paper.pdf": "pdf", "old.xls": "doc", "empty.html": "html", "large.txt": "txt", "binary.txt": None, "sub/deep.md": "txt", "cut.txt": "txt"}
    assert listing == {n: (len(made[n]), k) for n, k in kinds.items()}
    df = dc.read_documents(spark, root, partition_bytes=1 << 19)
    assert df.rdd.getNumPartitions() > 3
    rows: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.path, r.pos)):
        rows.setdefault(os.path.relpath(r.path, root), []).append((r.kind, r.text, r.rows))
    assert rows["good.html"] == [("heading", "One", None), ("paragraph", "text", None)]
    assert rows["no_extension"] == [("paragraph", "word", None), ("table", "", [["a\nb", "c"]])]
    assert "empty.html" not in rows and len(rows["large.txt"]) == 1 and [r[1] for r in rows["sub/deep.md"]] == ["a", "b"]
    assert {n: r[0][1] for n, r in rows.items() if r[0][0] == "error"} == {"broken.docx": "no parser", "named.docx": "BadZipFile: File is not a zip file", "other.docx": "no parser", "paper.pdf": "no parser", "old.xls": "no parser", "binary.txt": "no parser"}
    chunks, errors = dc.files_to_chunks(spark, root)
    assert errors.count() == 6 and {os.path.relpath(r.path, root) for r in chunks.select("path").distinct().collect()} == {"good.html", "no_extension", "large.txt", "sub/deep.md", "cut.txt"}


def test_empty_folder_and_packing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert dc.read_documents(spark, str(tmp_path / "in")).collect() == []
    parts = dc.packed([(f"f{i}", i * dc.OPEN_BYTES) for i in range(10)], 10 * dc.OPEN_BYTES)
    assert sorted(f for p in parts for f, _ in p) == sorted(f"f{i}" for i in range(10)) and max(sum(n + dc.OPEN_BYTES for _, n in p) for p in parts) <= 10 * dc.OPEN_BYTES


def plain_chunks(blocks: list[tuple]) -> list[tuple]:
    section, run, out, heads = 0, [], [], -1

    def flush():
        if run:
            out.extend((section, "paragraph", c) for c in plain_split("\n\n".join(run), paragraph=r"\n[ \t\n\r\f\v]*\n", joiner="\n\n"))
            run.clear()

    for kind, _, text, rows in blocks:
        if kind == "heading":
            if heads >= 0:  # what stands before the first heading belongs to its section
                flush()
            heads += 1
            section = max(heads, 0)
        elif kind == "table":
            flush()
            out.extend((section, "table", c) for c in plain_table(rows, 1200))
        else:
            run.append(text)
    flush()
    return out


def test_files_to_chunks_equal_a_plain_fold(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    want = set()
    for i, source in pages.items():
        if i % 9 == 0:
            want.add((i, -1, -1, "error", hashlib.sha256(b"no parser").hexdigest()))
            continue
        for n, (section, kind, content) in enumerate(plain_chunks(fl.html_blocks(source))):
            want.add((i, section, n, kind, hashlib.sha256(content.encode()).hexdigest()))
    got = [tuple(r) for r in QUERIES["files_to_chunks"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want
