"""vigil: model-monitoring analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame; grouping keys
(model, version, segment, window) are passed as ``group_cols`` so that one plan
serves many models at once.
"""

__version__ = "0.1.0"
