"""Every operator run over whole driver tables, with the SQL that must agree.

``QUERIES`` maps a name to a function (spark, folder) -> DataFrame, ``SQL`` maps
the name to equivalent SQL where the result can be written in SQL.
"""

from assayloom.catalog.registry import QUERIES, SQL
from assayloom.catalog import (  # noqa: F401  (they register their queries)
    charts,
    imports,
    integration,
    learning,
    matching,
    preprocessing,
    statistics,
    workflows,
)

__all__ = ["QUERIES", "SQL"]
