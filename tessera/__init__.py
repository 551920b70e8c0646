"""tessera: catalog profiling, semantic retrieval and question answering on Spark.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function so that Catalyst sees one declarative plan per job.
"""

from tessera.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
