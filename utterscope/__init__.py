"""utterscope — Spark-native analytics for short customer utterances.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark SQL expressions; see ``README.md`` for the module map.
"""

from utterscope.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
