"""Ledgerline: policy-driven payroll and document analytics on Spark."""
