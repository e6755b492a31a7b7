"""Data quality: rules, checks, scores and reports."""
