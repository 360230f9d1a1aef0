"""The ``opN_`` queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ball_tree, exact_dedup, host_rules, mixing, tool_chat
from .ball_tree import op11_ball_tree
from .cotraining import op5_quality
from .decontaminate import op4_decontaminate
from .exact_dedup import op6_exact_dedup
from .gru_lm import op8_gru_scores
from .host_rules import op13_host_rules
from .html_text import op7_html_text
from .jaccard_join import op9_jaccard_join
from .mixing import op1_mixing
from .spelling import op12_spelling
from .substring_dedup import op3_substring_dedup
from .token_counts import op10_token_counts
from .tool_chat import op2_tool_chat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_tool_chat": op2_tool_chat,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_html_text": op7_html_text,
    "op8_gru_scores": op8_gru_scores,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_counts": op10_token_counts,
    "op11_ball_tree": op11_ball_tree,
    "op12_spelling": op12_spelling,
    "op13_host_rules": op13_host_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.oracle(),
    "op2_tool_chat": tool_chat.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op11_ball_tree": ball_tree.oracle(),
    "op13_host_rules": host_rules.ORACLE,
}
