"""tickloom: tick-data feature engineering as Spark plans.

Every public function takes and returns DataFrames (or Columns) and runs no action of its own unless its
docstring says so, so Catalyst sees one plan from scan to sink.
"""

__version__ = "0.1.0"
