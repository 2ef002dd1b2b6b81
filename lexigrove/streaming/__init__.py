"""Operators over streams."""

from .minibatch import load_centers, stream_minibatch

__all__ = ["load_centers", "stream_minibatch"]
