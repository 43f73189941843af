"""rugosa: a Spark-native engine for tabular regression and ensembling.

Every operator takes and returns a Spark DataFrame; only parameter-sized
results (edges, lambdas, D x D Gram matrices, weights, metric rows) ever
reach the driver.
"""

from rugosa.settings import SETTINGS, Settings

__all__ = ["SETTINGS", "Settings"]
