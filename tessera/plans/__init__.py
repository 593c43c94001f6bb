"""Plans: lineage cuts, adapters of tables to graphs, and the library's queries."""
