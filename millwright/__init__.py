"""millwright — Spark-native predictive-maintenance analytics.

Every operator is a plain ``DataFrame -> DataFrame`` function (usable with
``df.transform``) or a small fit/transform pair whose fitted state is a handful
of literals.  Row work stays on executors; the driver only ever sees
one-row (or one-row-per-column / per-tier) statistics.
"""

from millwright.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
