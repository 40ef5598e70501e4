"""Attestry: provenance analytics for catalog facts, expressed as Spark DataFrame jobs."""
