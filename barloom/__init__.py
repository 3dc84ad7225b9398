"""barloom: market-panel and event-series analytics as plain PySpark DataFrame functions.

Every operator takes a long DataFrame keyed by instrument and time and returns another one.
"""

__version__ = "0.1.0"
