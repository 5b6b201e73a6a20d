"""Batch scoring with a pluggable scorer, and its restartable stream form."""
