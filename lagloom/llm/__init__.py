"""Training-data operators: token counts, filtering, deduplication, packing.

Nothing outside this subpackage imports it.  Each module holds one operator
and the thin query registered under its name; ``queries()`` and
``oracle_sql()`` gather them for the entry point.
"""

from __future__ import annotations


def queries():
    from lagloom.llm import registry

    return registry.queries()


def oracle_sql():
    from lagloom.llm import registry

    return registry.oracle_sql()
