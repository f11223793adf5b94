"""Operators for preparing training text: packing, search, scoring, extraction, formatting, tokens and near copies.

Nothing outside this folder imports it.
"""
