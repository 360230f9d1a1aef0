"""Document types: normalisation, eligibility and the scope of question answering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The document types, in declared order, and the older name of one.
DOCUMENT_TYPES = ("historical_bid", "tender", "enterprise_profile", "qualification", "project_case", "product_manual", "technical_document", "regulation", "other")
EXCLUDED_TYPE = "tender"
LEGACY_TYPES = {"tender_doc": "tender"}
DEFAULT_TYPE = "historical_bid"

QA_TYPES = tuple(t for t in DOCUMENT_TYPES if t != EXCLUDED_TYPE)


def canonical_type(c: Column) -> Column:
    value = F.trim(F.coalesce(c, F.lit("")))
    for old, new in LEGACY_TYPES.items():
        value = F.when(value == old, F.lit(new)).otherwise(value)
    return value


def normalised_type(c: Column, default: str = DEFAULT_TYPE) -> Column:
    """A known type; blank and unknown ones become the default."""
    value = canonical_type(c)
    return F.when(value.isin(*DOCUMENT_TYPES), value).otherwise(F.lit(default))


def is_excluded(c: Column) -> Column:
    return canonical_type(c) == EXCLUDED_TYPE


def may_have_patterns(c: Column) -> Column:
    """Unknown types may not."""
    return canonical_type(c).isin(*QA_TYPES)


def qa_types(requested: Column) -> Column:
    """Array column: the allowed types among those asked for, in declared order; all of them if that leaves none.

    The scope is only ever narrowed; the excluded type never gets in.
    """
    allowed = F.array(*(F.lit(t) for t in QA_TYPES))
    asked = F.transform(F.coalesce(requested, F.array().cast("array<string>")), canonical_type)
    kept = F.array_intersect(allowed, asked)
    return F.when(F.size(kept) == 0, allowed).otherwise(kept)


def qa_type_list(requested: Sequence[str | None] | None) -> list[str]:
    """The same for a request on the driver."""
    asked = {LEGACY_TYPES.get(v, v) for v in ((t or "").strip() for t in requested or ())}
    return [t for t in QA_TYPES if t in asked] or list(QA_TYPES)
