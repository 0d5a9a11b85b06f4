"""redsift: a Spark-native engine for planetary-image catalogues, patches and dataset statistics."""
