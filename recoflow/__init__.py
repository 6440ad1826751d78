"""recoflow: a Spark-native batch recommendation pipeline.

Interaction history -> temporal split -> per-user item frequencies ->
ranked top-K lists from three sources (implicit ALS, popularity inside
user clusters/segments, global popularity) -> hybrid merge -> nDCG@K,
Entropy@K and coverage on a later slice of the history.

Every step is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions and MLlib estimators; nothing runs as a Python UDF.
"""

from recoflow.config import DEFAULT_K

__all__ = ["DEFAULT_K"]
