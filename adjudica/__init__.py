"""Adjudica: Spark jobs that measure how far automatic pairwise judges can be trusted."""
