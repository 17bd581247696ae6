"""Registered queries: operators applied to the test tables."""

from . import bundle, corpus, curate, evidence, links, review, search, streams, usage, vectors  # noqa: F401
