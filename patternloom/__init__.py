"""Structure in unlabelled data, as Spark jobs: features, clusters, anomalies, topics, drift, graphs, series."""
