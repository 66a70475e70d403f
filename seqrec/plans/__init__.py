"""Plan-level helpers: session set-up, lineage cuts and guarded broadcasts."""
