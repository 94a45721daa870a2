"""A Spark-native store for vectors with nearest-neighbour search over namespaces, logical nodes and moving centroids."""
