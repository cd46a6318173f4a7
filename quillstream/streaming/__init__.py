"""Ordered session logic: pure steps, wrapped for batch and for streams."""
