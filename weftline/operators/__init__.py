"""DataFrame operators: statements, lineage, validation, graphs, refinement, stores and agents."""
