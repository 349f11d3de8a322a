"""All registered queries; importing this package fills the registry."""

from noticeloom.workload import (  # noqa: F401
    dedupe,
    discovery,
    extraction,
    files,
    quality,
    registry,
    reports,
    text,
)
from noticeloom.workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
