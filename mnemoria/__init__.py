"""Mnemoria: a PySpark-native analytics engine for agent memories.

The store is two relations, an operation log (``ops``) and the state derived
from it (``entries``); every read is a DataFrame query as of an explicit time
and every maintenance task is a DataFrame transformation.
"""

__version__ = "0.1.0"
