"""All query modules of the subpackage."""

from __future__ import annotations

from . import queries_events, queries_leak, queries_packing, queries_residue

MODULES = [queries_events, queries_packing, queries_leak, queries_residue]
