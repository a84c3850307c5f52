"""Learners and survival models fitted with Spark jobs."""
