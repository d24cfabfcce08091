"""Registry of the catalogue's queries and their SQL: every function q_<name>, with Q_<NAME> as its SQL."""

from __future__ import annotations

from . import details, textual, timed

MODULES = (timed, textual, details)
QUERIES = {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("q_")}
ORACLES = {name: getattr(m, name.upper()) for m in MODULES for name in vars(m) if name.startswith("q_") and hasattr(m, name.upper())}
