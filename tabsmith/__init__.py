"""tabsmith: profiling, cleaning and classification of large flat tables on Spark.

Everything is expressed with DataFrame / SQL operators and spark.ml; no Python
UDF sits on a hot path.  See README.md for the module map.
"""

from tabsmith.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
