"""gridpulse: field-asset KPI analytics (meter lifecycle and service tickets) on Spark.

Layout:
  sources/    fact bindings, file readers (CSV/staging), sinks
  functions/  reusable Column builders (categories, labels, predicates, filters)
  operators/  summary builders, roll-ups, joins, maintenance jobs
  plans/      dashboard queries and the full-refresh pipeline
  streaming/  incremental (micro-batch) upsert of staging data
"""

__version__ = "0.1.0"
