"""Spark-first analytics over norm and procedure documents."""
