"""The registered queries, by topic; importing this package registers them all."""

from . import answers, captions, coverage, documents, events, grounding, ingest, people, postings, retrieval, verification  # noqa: F401
