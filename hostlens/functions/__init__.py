"""Column functions: hostnames, suffixes, lexical features, decisions."""
