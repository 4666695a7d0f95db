"""Column expressions: names, canonical values, batch keys, hashes."""
