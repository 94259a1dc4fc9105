"""DataFrame operators for catalogue data, event logs and text corpora on Spark."""
