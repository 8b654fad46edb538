"""Errors a request can raise."""


class MetricError(Exception):
    """Base of all."""


class ContextError(MetricError):
    """The request is malformed."""


class BindError(MetricError):
    """A name, key or operator of the metric definition can't be bound."""


class FilterError(MetricError):
    """A filter has no column or a bad value."""


class TimePlanError(MetricError):
    """The time selection can't be planned."""


class CatalogError(MetricError):
    """A limit or rule of the catalog is broken."""


class CalcError(MetricError):
    """A calculation fails."""
