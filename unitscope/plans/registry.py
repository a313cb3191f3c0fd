"""All registered queries outside the llm subpackage."""

from __future__ import annotations

from unitscope.plans import checks, core, results, roundtrips, sequences

MODULES = [core, sequences, results, checks, roundtrips]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
