"""Bill-of-materials analytics on Spark: read, normalise, check, score and profile SBOM corpora."""

__version__ = "0.1.0"
