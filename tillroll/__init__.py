"""tillroll: everyday commercial analytics as Spark DataFrame jobs.

Layout
------
- ``functions``  column-level helpers (text clean-up, lists, dates, ordered concat)
- ``operators``  DataFrame -> DataFrame building blocks (ranking, keys, joins,
                 list changes, shares, cohorts, data-quality checks)
- ``plans``      the analysis jobs, one module per business domain, plus the
                 registry that wires them to the driver's tables
- ``sources``    table readers, stand-in tables derived from the driver's
                 tables, and sinks
- ``llm``        operators of a training-data pipeline (stands alone)
"""

__version__ = "0.1.0"
