"""Fraud-evidence correlation, scoring and custody jobs for Spark."""
