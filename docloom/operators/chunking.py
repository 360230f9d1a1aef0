"""Sections to chunks: greedy packing, hard cuts, overlap, tables.

Packing is a left fold over a document's paragraphs, written as aggregate() and kept in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalar import let, strip

MAX_CHARS = 1200
OVERLAP = 150
SENTENCE_END = r"(?<=[.!?;。！？；])"


def greedy_pack(parts: Column, max_chars: int, joiner: str) -> Column:
    """Array of parts to array of pieces: a part joins the piece before it while that stays within max_chars."""
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        joined = F.when(s["cur"] == "", x).otherwise(F.concat(s["cur"], F.lit(joiner), x))
        fits = F.length(joined) <= max_chars
        closed = F.when(s["cur"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"])))
        return F.struct(F.when(fits, joined).otherwise(x).alias("cur"), F.when(fits, s["out"]).otherwise(closed).alias("out"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"]))))


def hard_cut(text: Column, max_chars: int, overlap: int) -> Column:
    """Array of pieces of max_chars that each repeat ``overlap`` characters of the one before."""
    stride = max(1, max_chars - overlap)
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(stride)), lambda i: F.substring(text, i + 1, F.lit(max_chars))))


def with_overlap(pieces: Column, overlap: int) -> Column:
    """Each piece but the first, after the last ``overlap`` characters of the piece before (as it was)."""
    if overlap <= 0:
        return pieces
    return let(pieces, lambda all_: F.transform(all_, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.right(F.get(all_, i - 1), F.lit(overlap)), p))))


def split_long(text: Column, max_chars: int, overlap: int) -> Column:
    """Pieces of one long paragraph: sentences packed, sentences over max_chars cut hard, overlap applied."""
    sentences = F.filter(F.split(text, SENTENCE_END), lambda s: strip(s) != "")
    packed = greedy_pack(sentences, max_chars, "")
    return with_overlap(F.flatten(F.transform(packed, lambda p: hard_cut(p, max_chars, overlap))), overlap)


def semantic_split(text: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, paragraph: str = r"\n\s*\n", joiner: str = "\n\n") -> Column:
    """Array of chunks of a text: paragraphs packed up to max_chars, long ones split, overlap over all.

    Pieces of a long paragraph carry the overlap twice, as chunk lengths depend on it: a chunk may have
    up to max_chars + 2 * overlap characters.
    """
    whole = strip(F.coalesce(text, F.lit("")))
    parts = F.filter(F.transform(F.split(whole, paragraph), strip), lambda p: p != "")
    # Long paragraphs are pieces of their own; runs of short ones are packed between them.
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        joined = F.when(s["cur"] == "", x).otherwise(F.concat(s["cur"], F.lit(joiner), x))
        closed = F.when(s["cur"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"])))
        long = F.length(x) > max_chars
        fits = F.length(joined) <= max_chars
        return F.struct(
            F.when(long, F.lit("")).when(fits, joined).otherwise(x).alias("cur"),
            F.when(long, F.concat(closed, split_long(x, max_chars, overlap))).when(fits, s["out"]).otherwise(closed).alias("out"),
        )

    pieces = F.aggregate(parts, start, step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"]))))
    return F.when(whole == "", F.array().cast("array<string>")).when(F.length(whole) <= max_chars, F.array(whole)).otherwise(with_overlap(pieces, overlap))


def markdown_row(cells: Column) -> Column:
    """A table row with pipes and line breaks escaped."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))


def _rule(head: Column) -> Column:
    return F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(head)))


def markdown_table(rows: Column) -> Column:
    """Rows (array of arrays) as a pipe table, the first row as its head."""

    def whole(held: Column) -> Column:
        head = F.get(held, F.lit(0))
        return F.array_join(F.concat(F.array(markdown_row(head), _rule(head)), F.transform(F.slice(held, F.lit(2), F.size(held)), markdown_row)), "\n")

    return let(rows, lambda held: F.when(F.size(held) == 0, F.lit("")).otherwise(whole(held)))


def _row_groups(rows: Column, max_chars: int) -> Column:
    """Array of (first, length): the body rows of each group, packed by the length of their joined cells with the head's."""
    kind = "array<struct<first: int, length: int>>"

    def fold(sizes: Column) -> Column:
        start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("length"), F.get(sizes, F.lit(0)).alias("n"), F.array().cast(kind).alias("out"))
        group = lambda s: F.struct(s["first"].alias("first"), s["length"].alias("length"))

        def step(s, size):
            fits = (s["n"] + size <= max_chars) | (s["length"] == 0)
            return F.struct(
                F.when(fits, s["first"]).otherwise(s["first"] + s["length"]).alias("first"),
                F.when(fits, s["length"] + 1).otherwise(1).alias("length"),
                F.when(fits, s["n"] + size).otherwise(F.get(sizes, F.lit(0)) + size).alias("n"),
                F.when(fits, s["out"]).otherwise(F.concat(s["out"], F.array(group(s)))).alias("out"),
            )

        return F.aggregate(F.slice(sizes, F.lit(2), F.size(sizes)), start, step, lambda s: F.when(s["length"] == 0, s["out"]).otherwise(F.concat(s["out"], F.array(group(s)))))

    return let(F.transform(rows, lambda r: F.length(F.array_join(r, " "))), fold)


def pack_table(rows: Column, max_chars: int) -> Column:
    """Array of row groups: the head repeated, body rows packed by the length of their joined cells."""

    def groups(held: Column) -> Column:
        return F.transform(_row_groups(held, max_chars), lambda g: F.concat(F.slice(held, F.lit(1), F.lit(1)), F.slice(held, g["first"] + 2, g["length"])))

    return let(rows, groups)


def table_chunks(rows: Column, max_chars: int = MAX_CHARS) -> Column:
    """The whole table if it fits, else one markdown table per row group."""

    def parts(held: Column, lines: Column) -> Column:
        # Each row is written out once; groups join the lines of theirs after those of the head.
        head = F.concat(F.get(lines, F.lit(0)), F.lit("\n"), _rule(F.get(held, F.lit(0))), F.lit("\n"))
        one = lambda head: F.transform(_row_groups(held, max_chars), lambda g: F.concat(head, F.array_join(F.slice(lines, g["first"] + 2, g["length"]), "\n")))
        return let(head, one)

    def chunks(held: Column) -> Column:
        many = let(F.transform(held, markdown_row), lambda lines: parts(held, lines))
        return F.when(F.size(held) == 0, F.array().cast("array<string>")).otherwise(let(markdown_table(held), lambda whole: F.when(F.length(whole) <= max_chars, F.array(whole)).otherwise(many)))

    return let(rows, chunks)


def list_text(items: Column, ordered: Column) -> Column:
    """List items by line with a bullet or number; numbers do not count up."""
    return F.array_join(F.transform(items, lambda i: F.concat(F.when(ordered, F.lit("1. ")).otherwise(F.lit("- ")), i)), "\n")


def page_marked(blocks: DataFrame) -> DataFrame:
    """(document_id, text): texts by line with a mark where the page changes; images are skipped."""
    by_pos = Window.partitionBy("document_id").orderBy("pos")
    shown = blocks.filter("kind <> 'image'").withColumn("_new", ~F.col("page").eqNullSafe(F.lag("page").over(by_pos)))
    line = F.when(F.col("_new"), F.concat(F.lit("[page "), F.col("page").cast("string"), F.lit("]\n"), F.col("text"))).otherwise(F.col("text"))
    rows = shown.select("document_id", "pos", line.alias("line")).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    return rows.select("document_id", F.array_join("rows.line", "\n").alias("text"))


def document_chunks(blocks: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of documents whose blocks have section_id: text runs between tables are split, tables packed.

    chunk_index counts over the document; ``rows`` (array of arrays) holds a table's cells.
    """
    by_pos = Window.partitionBy("document_id").orderBy("pos")
    body = blocks.filter("kind <> 'heading' AND kind <> 'image'").withColumn("_table", (F.col("kind") == "table").cast("int"))
    run = F.sum(F.col("_table")).over(by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    body = body.withColumn("_run", run)
    texts = body.filter("_table = 0").groupBy("document_id", "section_id", "_run").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"))
    text_chunks = texts.select("document_id", "section_id", "pos", F.lit("paragraph").alias("chunk_type"), F.posexplode(semantic_split(F.array_join("parts.text", "\n\n"), max_chars, overlap)).alias("part", "content"))
    tables = body.filter("_table = 1").select("document_id", "section_id", "pos", F.lit("table").alias("chunk_type"), F.posexplode(table_chunks(F.col("rows"), max_chars)).alias("part", "content"))
    order = Window.partitionBy("document_id").orderBy("pos", "part")
    return text_chunks.unionByName(tables).withColumn("chunk_index", F.row_number().over(order) - 1).select("document_id", "section_id", "chunk_index", "chunk_type", "content")
