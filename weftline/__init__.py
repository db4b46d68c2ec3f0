"""weftline: lineage analytics over SQL text as DataFrame programs."""
