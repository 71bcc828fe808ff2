"""DataFrame operators: catalog, blocks, layout, repetition, linking, tables."""
