"""Queries that read folders of files: what lies there, and the way from files to chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.plans import queries as q
from docloom.plans import views as v
from docloom.session import shared_path
from docloom.sources import documents as dc


def _folder(spark, sf) -> str:
    """The pages as files; those whose number 9 divides have a name that says nothing, and one more byte in front."""
    folder = f"{shared_path(spark, 'files')}/in"
    i = F.col("page_id")
    odd = i % 9 == 0
    name = F.concat(F.lit("p"), i.cast("string"), F.when(odd, F.lit(".bin")).otherwise(F.lit(".html")))
    html = F.col("html").cast("binary")
    dc.put_files(v.t(spark, sf, "pages").select(name.alias("name"), F.when(odd, F.concat(F.lit("\0").cast("binary"), html)).otherwise(html).alias("content")), folder)
    return folder


def _page(path: F.Column) -> F.Column:
    return F.regexp_extract(path, r"p(\d+)\.\w+$", 1).cast("long").alias("page_id")


@q.query("file_listing", "SELECT page_id, octet_length(encode(html)) + (page_id % 9 = 0)::INT AS size, CASE WHEN page_id % 9 <> 0 THEN 'html' ELSE 'none' END AS file_type FROM pages")
def file_listing(spark, sf):
    """Size and type of every file of a folder; only the heads are read."""
    rows = dc.read_documents(spark, _folder(spark, sf), blocks=False)
    return rows.select(_page(F.col("path")), "size", F.coalesce("file_type", F.lit("none")).alias("file_type"))


@q.query("files_to_chunks")
def files_to_chunks(spark, sf):
    """A folder's files to blocks, sections and chunks (compared with a plain fold in the tests); errors are rows of their own."""
    chunks, errors = dc.files_to_chunks(spark, _folder(spark, sf))
    made = chunks.select(_page(F.col("path")), "section_id", "chunk_index", "chunk_type", F.sha2("content", 256).alias("content_hash"))
    lost = errors.select(_page(F.col("path")), F.lit(-1).alias("section_id"), F.lit(-1).alias("chunk_index"), F.lit("error").alias("chunk_type"), F.sha2("error", 256).alias("content_hash"))
    return made.unionByName(lost)
