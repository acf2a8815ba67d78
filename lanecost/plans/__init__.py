"""Marts, summaries, KPIs and quality checks, each a lazy DataFrame."""
