"""Composed jobs: the rollup rebuild and the report sections."""
