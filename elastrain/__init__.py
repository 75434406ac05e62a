"""Distributed training dataflows for labelled arrays, written as Spark DataFrame jobs."""
