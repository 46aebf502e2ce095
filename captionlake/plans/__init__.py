"""The catalogue of queries; importing the package fills it."""

from . import captions, catalogue, records  # noqa: F401
