"""Incremental panels as structured streams."""
