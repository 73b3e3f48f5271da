"""Analysis of note collections on Spark: parsing, retrieval, link graphs, claims, clusters, and their evaluation."""
