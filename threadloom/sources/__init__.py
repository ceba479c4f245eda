"""Readers and writers for pages, threads, tables, sheets and lists."""
