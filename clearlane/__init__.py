"""Referral auto-approval analytics expressed as Spark DataFrame jobs."""
