"""Whole programs: audits, source validation, reports, and the registered queries."""
