"""graphloom: source-graph indexing, retrieval and corpus preparation on Spark.

Every operator takes and returns DataFrames; nothing here starts a session by
itself except :func:`graphloom.runtime.local_session`, which tests and the
command line use.
"""

__version__ = "0.1.0"

SCHEMA_VERSION = 1
EXTRACTOR_STAMP = "graphloom-1"
