"""gazette: a Spark-native news-digest engine.

Every public function takes and returns DataFrames (or Columns); nothing
here collects data to the driver. See README.md for the module map.
"""

__version__ = "0.1.0"
