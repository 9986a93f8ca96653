"""Operators of training-data pipelines: whole texts in, one decision or score per document out."""
