"""Imports every catalog module so that the registry is complete."""

from plumbline.catalog import (  # noqa: F401
    changelog,
    compare,
    conformance,
    findings,
    grading,
    graph,
    profile,
    references,
    similarity,
    sources,
    streaming,
    text,
    verdicts,
    windows,
)
from plumbline.catalog.base import REGISTRY  # noqa: F401
