"""Column functions: identifiers, paths, canonical JSON and text."""
