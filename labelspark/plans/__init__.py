"""User-level plans composed from the operators."""
