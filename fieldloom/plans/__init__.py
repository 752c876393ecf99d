"""Reusable plan shapes: checkpoints, global order, blocked matching."""
