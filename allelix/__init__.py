"""A Spark-native engine for genotype tables, association scans and the steps around them."""
