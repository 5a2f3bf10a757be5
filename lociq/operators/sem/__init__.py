"""Structural equation models: model text, compiled matrices, batched fits, statistics."""
