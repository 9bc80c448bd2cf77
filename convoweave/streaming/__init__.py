"""Incremental reading: cursors over growing files, turns from streams of records, idle sessions."""
