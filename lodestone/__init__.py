"""Lodestone: an evidence-first analytics engine on PySpark."""
