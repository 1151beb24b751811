"""Distributed estimators: sums of products on the cluster, small solves on one row a model."""
