"""Registered queries. Importing this package registers them all."""

from veridoc.plans import corpus, history, links, sources, text, verdicts, workflow  # noqa: F401
