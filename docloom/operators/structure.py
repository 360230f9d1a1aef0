"""Blocks to section trees.  ``blocks`` has document_id, pos, kind, level, text (and page).

All per-document work is windows over (document_id, pos) or one array per document; nothing is looped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalar import strip

MAX_LEVEL = 9


#: Numbers of more parts than this count as text ("1.2.3.4 x" is no heading).
NUMBER_PARTS = 3


def _numbered_level(text: Column) -> Column:
    """How many parts the number has that a text starts with, where words follow it; null without such a number."""
    pieces = F.split(text, r"\s+", 2)
    parts = F.split(F.get(pieces, F.lit(0)), r"\.")
    return F.when((F.size(pieces) == 2) & (F.size(parts) <= NUMBER_PARTS) & F.forall(parts, lambda x: x.rlike("^[0-9]+$")), F.size(parts))


def heading_level(text: Column, rules: Sequence[tuple[str, int]], dotted: bool = True) -> Column:
    """Level of a heading by (pattern, level) rules, first match first; then by its number ("2.1 Title" is 2)."""
    t = strip(text)
    out = _numbered_level(t) if dotted else F.lit(None).cast("int")
    for pattern, level in reversed(rules):
        out = F.when(t.rlike(pattern), F.lit(level)).otherwise(out)
    return out


def section_number(text: Column, chapter: str | None = None) -> Column:
    """A leading chapter mark (by pattern) or dotted number, else null."""
    t = strip(text)
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)*)(?:[\s.]|$)", 1)
    if chapter:
        mark = F.regexp_extract(t, f"^({chapter})", 1)
        number = F.when(mark != "", mark).otherwise(number)
    return F.when(number != "", number)


def style_level(style: Column) -> Column:
    digit = F.regexp_extract(style, r"([0-9])", 1)
    return F.when(digit != "", digit.cast("int")).otherwise(F.lit(1))


def section_tree(blocks: DataFrame, orphan_root: bool = True) -> DataFrame:
    """One row per section: document_id, pos (of its heading), section_id, parent_id, level, title, end_pos.

    The parent is the nearest heading before with a smaller level; section_id counts headings in page
    order, which is the preorder of the tree.  end_pos is the position of the next heading that is not
    below.  Documents without headings get one section of level 0 over all their blocks
    (``orphan_root``), so no content is lost.
    """
    by_pos = Window.partitionBy("document_id").orderBy("pos")
    before = by_pos.rowsBetween(Window.unboundedPreceding, -1)
    # Backwards, so that the frame grows row by row instead of being read again for each row.
    after = Window.partitionBy("document_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.filter("kind = 'heading'").withColumn("level", F.least(F.greatest("level", F.lit(1)), F.lit(MAX_LEVEL)))
    heads = heads.withColumn("section_id", F.row_number().over(by_pos) - 1)
    above = F.array(*(F.last(F.when(F.col("level") < k, F.col("section_id")), ignorenulls=True).over(before) for k in range(1, MAX_LEVEL + 1)))
    stop = F.array(*(F.last(F.when(F.col("level") <= k, F.col("pos")), ignorenulls=True).over(after) for k in range(1, MAX_LEVEL + 1)))
    tree = heads.select("document_id", "pos", "section_id", F.element_at(above, F.col("level")).alias("parent_id"), "level", F.col("text").alias("title"), F.element_at(stop, F.col("level")).alias("end_pos"))
    if not orphan_root:
        return tree
    bare = blocks.groupBy("document_id").agg(F.max((F.col("kind") == "heading").cast("int")).alias("any_heading")).filter("any_heading = 0")
    root = bare.select("document_id", F.lit(-1).alias("pos"), F.lit(0).alias("section_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("level"), F.lit("").alias("title"), F.lit(None).cast("int").alias("end_pos"))
    return tree.unionByName(root)


def assign_sections(blocks: DataFrame) -> DataFrame:
    """Blocks with the section_id they belong to; blocks before the first heading belong to the first section."""
    by_pos = Window.partitionBy("document_id").orderBy("pos")
    number = F.sum((F.col("kind") == "heading").cast("int")).over(by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blocks.withColumn("section_id", F.greatest(number - 1, F.lit(0)).cast("int"))


def page_ranges(tree: DataFrame) -> DataFrame:
    """tree(document_id, section_id, parent_id, page) with page_start and page_end (over direct children)."""
    children = tree.filter("parent_id IS NOT NULL").groupBy("document_id", F.col("parent_id").alias("section_id")).agg(F.max("page").alias("child_page"))
    return tree.join(children, ["document_id", "section_id"], "left").select("document_id", "section_id", F.col("page").alias("page_start"), F.greatest("page", F.coalesce("child_page", "page")).alias("page_end"))


def own_content(blocks: DataFrame) -> DataFrame:
    """(document_id, section_id, content): a section's own texts by line; images and empty texts are skipped."""
    body = assign_sections(blocks).filter("kind NOT IN ('heading', 'image') AND text <> ''")
    rows = body.groupBy("document_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("rows"))
    return rows.select("document_id", "section_id", F.array_join("rows.text", "\n").alias("content"))


def full_content(blocks: DataFrame, tree: DataFrame) -> DataFrame:
    """(document_id, section_id, full_content): own texts and those of the subtree, with a line for each heading below.

    Headings with nothing below them are left out.  Each line goes to its section and the sections above,
    which are at most MAX_LEVEL, so the rows grow with the depth of the tree and not with its sections.
    """
    by_pos = Window.partitionBy("document_id").orderBy("pos")
    before = by_pos.rowsBetween(Window.unboundedPreceding, -1)
    heading = F.col("kind") == "heading"
    number = F.sum(heading.cast("int")).over(by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    lines = blocks.filter("kind <> 'image'").select("document_id", "pos", "text", heading.alias("_heading"), number.alias("_own")).filter("text <> ''")
    # The nearest section of a smaller level for each level up to the own one: those above, from the top.
    nearest = F.array(*(F.last(F.when(F.col("level") < k, F.col("section_id")), ignorenulls=True).over(before) for k in range(1, MAX_LEVEL + 1)))
    # A root without heading (pos -1) takes the lines before any heading.
    own = F.when(F.col("pos") < 0, F.lit(-1)).otherwise(F.col("section_id"))
    paths = tree.select("document_id", "section_id", own.alias("_own"), nearest.alias("_near"), "level")
    paths = paths.select("document_id", "section_id", "_own", F.array_distinct(F.filter(F.slice("_near", F.lit(1), F.col("level")), lambda s: s.isNotNull())).alias("_up"))
    placed = lines.join(paths, ["document_id", "_own"])
    body = placed.filter("NOT _heading").select("document_id", "pos", "text", F.explode(F.concat(F.array("section_id"), "_up")).alias("section_id"))
    filled = body.select("document_id", "section_id").distinct()
    heads = placed.filter("_heading").join(filled, ["document_id", "section_id"], "left_semi").select("document_id", "pos", "text", F.explode("_up").alias("section_id"))
    rows = body.unionByName(heads).groupBy("document_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("rows"))
    out = tree.select("document_id", "section_id").join(rows, ["document_id", "section_id"], "left")
    return out.select("document_id", "section_id", F.coalesce(F.array_join("rows.text", "\n"), F.lit("")).alias("full_content"))


def classify_titles(sections: DataFrame, rules: DataFrame, default: str = "other") -> DataFrame:
    """Adds section_type: the first rule (by rule_order) of the row's rule_set with a keyword in the title.

    rules: rule_set, rule_order, section_type, keyword.  They go to every task as one array per rule set,
    so titles are not shuffled.
    """
    sets = rules.groupBy("rule_set").agg(F.array_sort(F.collect_list(F.struct("rule_order", "section_type", "keyword"))).alias("_rules"))
    hit = F.get(F.filter("_rules", lambda r: F.contains(F.col("title"), r["keyword"])), F.lit(0))
    return sections.join(F.broadcast(sets), "rule_set", "left").withColumn("section_type", F.coalesce(hit["section_type"], F.lit(default))).drop("_rules")


def not_a_solution(section_type: Column, title: Column, types: Sequence[str], words: Sequence[str]) -> Column:
    """Administrative sections by type or by a word of the title."""
    out = section_type.isin(*types) if types else F.lit(False)
    for w in words:
        out = out | F.contains(title, F.lit(w))
    return out


def candidate_sections(sections: DataFrame, types: Sequence[str], words: Sequence[str], min_level: int = 1, max_level: int = 3, min_chars: int = 300) -> DataFrame:
    """Sections worth extracting: level in range, subtree long enough, not administrative."""
    return sections.filter(F.col("level").between(min_level, max_level) & (F.length("full_content") >= min_chars) & ~not_a_solution(F.col("section_type"), F.col("title"), types, words))


def rule_rows(rule_set: str, rules: Mapping[str, Sequence[str]]) -> list[tuple]:
    """Rules of a mapping type -> keywords, in its order."""
    return [(rule_set, k, name, word) for k, (name, words) in enumerate(rules.items()) for word in words]


RULE_SCHEMA = "rule_set string, rule_order int, section_type string, keyword string"
