"""cladewise: profile-driven sequence curation as Spark DataFrame operators."""
