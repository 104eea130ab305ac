"""Corroba: corpus grounding and claim-to-evidence analytics, written for Spark."""
