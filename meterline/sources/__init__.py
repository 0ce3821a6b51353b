"""Readers that turn raw inputs into fact tables, and the keyed writers."""
