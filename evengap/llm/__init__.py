"""Operators of a training-data pipeline: packing, extraction, licences, chat, privacy, contamination, copies, search."""
