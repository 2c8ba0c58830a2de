"""Part of the goldweave engine."""
