"""Claim traceability on Spark: which numbers of a corpus are bound, exempt, quoted, or backed by nothing."""
