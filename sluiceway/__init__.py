"""sluiceway: evidence-gated question answering and corpus processing on Spark.

Everything is a pure ``DataFrame -> DataFrame`` function; see ``plans.registry`` for
the named queries and ``plans.engine`` for the batch question-answering engine.
"""

__version__ = "0.1.0"
