"""quire: a Spark-native engine that turns raw documents and records into a
clean, chunked, searchable corpus and answers batches of questions from it.

Every operator is a function Column -> Column or DataFrame -> DataFrame built
from Spark SQL expressions, so Catalyst can prune, push down and codegen it.
Python runs inside tasks only where a model, a file parser or a bounded
per-cell numeric kernel plugs in.
"""

__version__ = "0.1.0"
