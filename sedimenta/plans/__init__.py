"""The queries; importing this package registers them."""

from . import relational, scans, searches, streams, writes  # noqa: F401
