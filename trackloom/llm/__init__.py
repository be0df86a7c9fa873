"""Operators for training data: capping, similar vectors, clusters, leaked passages, mixtures, personal details."""
