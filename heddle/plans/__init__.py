"""Plans; importing the package fills the catalogue."""

from . import catalogue, curation, exchange  # noqa: F401
