"""Siftwork: engineering artifacts (logs, runs, source trees, graphs, settings) as Spark tables."""
