"""claimweave: claim verification and text-bias analytics as Spark jobs."""
