"""textsense: text sentiment, retrieval and chat-log analytics as Spark DataFrame jobs.

Every public operator takes and returns DataFrames (or Columns) so Catalyst plans the
whole chain; see README.md for the operator inventory.
"""

__version__ = "0.1.0"
