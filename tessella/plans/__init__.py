"""Registered queries; importing this package fills the catalog."""

from . import contract_checks, curation, extensions, gates, measures, records, reports, sources_code, stock, texts  # noqa: F401
