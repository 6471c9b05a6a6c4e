"""strata: a layered sales-analytics library on Spark DataFrames.

Bronze (append-only history) -> silver (typed, validated, merged current
table) -> gold (business attributes) -> consumption (star schema and marts).
Every function takes and returns lazy DataFrames built from built-in Spark
expressions, so planning stays with Catalyst and adaptive execution.
"""

__all__ = ["functions", "sources", "operators", "plans", "streaming", "session"]
