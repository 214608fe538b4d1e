"""The registered queries and the SQL that each of them has to agree with."""

from checks.common import Check
from checks import aggregates, diagnostics, filters, metrics, named, rules, series, windows

MODULES = (filters, aggregates, windows, metrics, rules, series, diagnostics, named)


def all_checks() -> dict[str, Check]:
    found: dict[str, Check] = {}
    for module in MODULES:
        for name, check in module.CHECKS.items():
            if name in found:
                raise ValueError(f"query {name!r} is registered twice")
            found[name] = check
    return found
