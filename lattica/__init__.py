"""A Spark-native engine for graph queries, rules, search and corpus pipelines."""
