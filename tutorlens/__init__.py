"""tutorlens: early detection of academic risk, written as Spark DataFrame jobs.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, usable with ``df.transform(...)``; nothing inside an operator
triggers an action. ``tutorlens.plans.analysis.analyze`` composes them.
"""

__version__ = "0.1.0"
