"""One exception type per family of user mistakes; all are raised before a Spark job starts where possible."""


class AnalyticsError(ValueError):
    """Base class: the request cannot be answered as asked."""


class PlanError(AnalyticsError):
    """A query plan names an unknown operation, column, aggregation or frequency."""


class FilterError(PlanError):
    """A filter names an unknown column or operator, or a value of the wrong type."""


class ChartError(AnalyticsError):
    """A chart spec cannot be drawn."""


class CleaningError(AnalyticsError):
    """A cleaning action is unknown or does not fit its column."""


class SeriesError(AnalyticsError):
    """A time series or forecast request cannot be answered."""


class AnomalyError(AnalyticsError):
    """An anomaly request cannot be answered."""


class TrainingError(AnalyticsError):
    """A training or prediction request cannot be answered."""


class IngestError(AnalyticsError):
    """A file cannot be read as a table."""
