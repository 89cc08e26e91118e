"""Readers and writers beyond spark.read and df.write."""
