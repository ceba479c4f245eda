"""Registered queries, each next to the SQL that checks it."""

from threadloom.plans import (  # noqa: F401  registering on import
    arrivals,
    codes,
    conversations,
    learning,
    samples,
    scans,
    tables,
    texts,
)
