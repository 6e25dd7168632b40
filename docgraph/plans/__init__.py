"""Physical helpers: durable cuts of lineage and iterative plans."""
