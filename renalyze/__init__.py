"""renalyze: clinical HL7 message analytics on Spark.

Entry points: ``renalyze.plans.catalog`` (every operator as a query),
``renalyze.plans.alerts`` (message -> tables -> features -> alerts),
``renalyze.streaming`` (Structured Streaming) and ``renalyze.cli``.
Call ``renalyze.session.prepare(spark)`` on a session created elsewhere.
"""

__version__ = "0.1.0"
