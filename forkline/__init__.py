"""Two-model selection analytics as Spark jobs.

Given a cheap model and a strong model, the jobs in this package work out which
label-free signals tell that a query needs the strong one, fit a threshold
policy on those signals and apply it to tables and streams.
"""

__version__ = "0.1.0"
