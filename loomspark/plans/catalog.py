"""Every query of the operators proper, with its SQL."""

from __future__ import annotations

from . import audits, corpus, grounding, reports, selection, studies, texts
from .common import Query

_MODULES = (selection, texts, corpus, audits, studies, grounding, reports)
QUERIES: dict[str, Query] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
