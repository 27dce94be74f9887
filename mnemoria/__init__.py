"""Corpus analytics for timestamped notes, transcripts, edits and vectors on Spark."""

__version__ = "0.1.0"
