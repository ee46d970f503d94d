"""Report result: a one-row header frame plus named detail frames."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Callable, Optional, Union

from pyspark.sql import DataFrame

Frame = Union[DataFrame, Callable[[], DataFrame]]


def _resolve(v):
    return v() if v is not None and not isinstance(v, DataFrame) else v


class _LazyFrames(Mapping):
    """Name → frame, each built on first access (plan construction is not free)."""

    def __init__(self, frames: dict):
        self._raw = dict(frames)
        self._done: dict = {}

    def __getitem__(self, k):
        if k not in self._done:
            self._done[k] = _resolve(self._raw[k])
        return self._done[k]

    def __iter__(self):
        return iter(self._raw)

    def __len__(self):
        return len(self._raw)


class Report:
    """A lazily evaluated report.

    ``header`` holds the report's scalar fields as one row; ``details`` holds
    its main list of records (None for reports without one) and ``sections``
    any further named lists (P&L has two). Each frame may be given as a
    builder and is planned on first access; nothing runs until an action is
    called on a frame. ``top_n`` is the limit of the list, if it has one.
    """

    def __init__(self, kind: str, header: Frame, details: Optional[Frame] = None,
                 sections: Optional[dict] = None, top_n: Optional[int] = None):
        self.kind = kind
        self.top_n = top_n
        self._frames = _LazyFrames({"header": header, "details": details})
        self.sections = _LazyFrames(sections or {})

    @property
    def header(self) -> DataFrame:
        return self._frames["header"]

    @property
    def details(self) -> Optional[DataFrame]:
        return self._frames["details"]

    def frames(self) -> dict:
        out = {"header": self.header}
        if self._frames._raw["details"] is not None:
            out["details"] = self.details
        out.update({k: self.sections[k] for k in self.sections})
        return out
