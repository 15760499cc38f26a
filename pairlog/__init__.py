"""Analytics over pairwise interaction logs, text claims, embeddings and pairing schedules.

Every public function takes and returns Spark DataFrames or Columns; nothing here
starts a job on its own except where a docstring says so.
"""

__version__ = "0.1.0"
