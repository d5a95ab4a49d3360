"""Column functions: text, paths, patches, identifiers, vectors."""
