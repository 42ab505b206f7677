"""Claim-document analytics on Spark."""
