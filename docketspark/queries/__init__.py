"""The catalogue's queries; importing this package registers them."""

from . import aggregates, filters, joins, scalars, streams, tools

__all__ = ["aggregates", "filters", "joins", "scalars", "streams", "tools"]
