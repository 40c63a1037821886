"""Test-integrity analytics and corpus operators as Spark plans."""
