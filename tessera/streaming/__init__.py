"""The stateless plan over a stream of diffs."""
