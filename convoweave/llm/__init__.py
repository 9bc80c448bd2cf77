"""Operations of a training-data pipeline: mixing, deduplication, extraction, filters, archives, tokens.

Nothing outside this subpackage imports it.
"""
