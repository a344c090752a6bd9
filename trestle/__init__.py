"""trestle — portfolio scorecard analytics as Spark DataFrame transformations.

Every operator is a function ``DataFrame -> DataFrame`` (or ``-> Column``)
built from ``pyspark.sql.functions``; there is no Python UDF anywhere, so all
work stays inside Catalyst / whole-stage codegen.

Layout
------
``sources``    readers (CSV / object store / test-table adapter) and dimensions
``functions``  Column-level helpers: lenient parsing, score math, formatting
``operators``  DataFrame-level operators: cleaning, filters, joins, aggregates,
               ranking, scoreboard, facets
``plans``      the composite queries a dashboard user runs, and the registry
``streaming``  (empty: the reference has no streaming surface)
"""

from trestle.config import PRESETS, Profile, Selection

__all__ = ["PRESETS", "Profile", "Selection"]
