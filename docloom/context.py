"""Tenant scope: mandatory predicates, checked before any plan is built."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TenantError(ValueError):
    pass


def require_tenant(value: object) -> int:
    """A positive integer that is no bool, or an error."""
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise TenantError(f"tenant must be a positive integer, not {value!r}")
    return value


@dataclass(frozen=True)
class TenantContext:
    """tenant is mandatory; enterprise and knowledge base narrow it where given."""

    tenant_id: int
    enterprise_id: int | None = None
    knowledge_base_id: int | None = None

    def __post_init__(self) -> None:
        require_tenant(self.tenant_id)

    def predicate(self, columns: Sequence[str]) -> Column:
        """Equality on tenant and on whatever else is set and present."""
        if "tenant_id" not in columns:
            raise TenantError("rows have no tenant_id; use trusted_documents()")
        out = F.col("tenant_id") == self.tenant_id
        for name in ("enterprise_id", "knowledge_base_id"):
            value = getattr(self, name)
            if value is not None and name in columns:
                out = out & (F.col(name) == value)
        return out

    def scope(self, rows: DataFrame) -> DataFrame:
        return rows.filter(self.predicate(rows.columns))

    def trusted_documents(self, documents: DataFrame) -> DataFrame:
        """Ids of the tenant's documents: the scope of tables without a tenant column."""
        return self.scope(documents).select(F.col("id").alias("document_id"))

    def scope_by_document(self, rows: DataFrame, documents: DataFrame) -> DataFrame:
        """Rows of trusted documents; no trusted document means no rows, never no filter."""
        return rows.join(self.trusted_documents(documents), "document_id", "left_semi")
