"""All registered queries; importing the modules fills the registry."""

from . import files, intervals, metrics, reads, report, scans, sequences, signals, structures, tables, texts, variants  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
