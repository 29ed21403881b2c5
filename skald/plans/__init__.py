"""The query catalogue; the other modules add to the tables that ``catalogue`` starts."""

from . import catalogue, documents, lore, merging, messages, questions, records, state, steps, training  # noqa: F401
