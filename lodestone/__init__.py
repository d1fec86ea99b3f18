"""Lodestone: a Spark-native engine for relational, survey, longitudinal and geographic analysis."""
