"""Insight and analytics operators for flat business tables, written for Spark."""
