"""tickloom: market-research analytics as Spark DataFrame operators.

Every public operator takes and returns DataFrames; nothing here runs a job
on its own except the sinks in ``tickloom.sources`` and the model fit.
"""

__version__ = "0.1.0"
