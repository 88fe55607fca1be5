"""All registered queries and their checking SQL."""

from specmill.plans import other_checks, report_checks, rules_checks, standardise_checks, structure_checks

_MODULES = [standardise_checks, rules_checks, structure_checks, report_checks, other_checks]
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
CHECKS = {name: sql for m in _MODULES for name, sql in m.CHECKS.items()}
