"""The version state machine as a stream: state per document, late versions are stale, deletes are final."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators.lifecycle import fold_requests

OUTPUT = "document_id long, tenant_id long, lifecycle_status string, current_index_version long, index_input_hash string, n_applied long, n_requests long"
_STATE = "tenant_id long, lifecycle_status string, version long, digest string, n_applied long, n_requests long"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values("request_id")
    held = state.get if state.exists else (None, None, None, None, 0, 0)
    start = None if held[1] is None else tuple(held[:4])
    none = lambda v: None if pd.isna(v) else v
    end, verdicts = fold_requests(start, ((int(t), int(v), none(h), o) for t, v, h, o in zip(rows["tenant_id"], rows["index_version"], rows["input_hash"], rows["op"], strict=True)))
    applied, total = held[4] + verdicts.count("APPLY"), held[5] + len(verdicts)
    end = end or (None, None, None, None)
    state.update((*end, applied, total))
    yield pd.DataFrame({"document_id": [key[0]], "tenant_id": pd.array([end[0]], dtype="Int64"), "lifecycle_status": [end[1]], "current_index_version": pd.array([end[2]], dtype="Int64"), "index_input_hash": [end[3]], "n_applied": [applied], "n_requests": [total]})


def version_stream(requests: DataFrame) -> DataFrame:
    """The guard row of every document that a micro-batch touches (update mode); state never expires."""
    return requests.groupBy("document_id").applyInPandasWithState(_step, OUTPUT, _STATE, "update", GroupStateTimeout.NoTimeout)
