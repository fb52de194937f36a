"""Every query of the library's own operators, and the SQL that checks it."""

from __future__ import annotations

from ..functions import names, plans, text, titles
from ..sources import files
from ..streaming import machines, progress
from . import evaluation, folds, frames, ledger, measures, near, plan, quality, screen, scripts, spread, stages, terms, transcript, words

_MODULES = (transcript, words, near, spread, measures, stages, scripts, quality, ledger, screen, plan, terms, frames, evaluation)


def queries() -> dict:
    return {q.name: q for m in _MODULES for q in m.QUERIES} | folds.queries() | text.queries() | titles.queries() | names.queries() | plans.queries() | files.queries() | machines.queries() | progress.queries()


def oracle_sql() -> dict[str, str]:
    return {q.name: q.oracle() for m in _MODULES for q in m.QUERIES if q.checked} | folds.oracle_sql() | plans.oracle_sql() | files.oracle_sql() | machines.oracle_sql() | progress.oracle_sql()
