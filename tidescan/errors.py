"""Exceptions raised by the engine and, below ApiError, by the request layer."""


class EngineError(Exception):
    """Base of everything this package raises on purpose."""


class SchemaError(EngineError):
    """A column, id or index that clashes with the schema or is missing from it."""


class ScanError(EngineError):
    """A scan that can't be planned: wrong literal type, unknown column, unsupported pattern."""


class AppendError(EngineError):
    """A batch that doesn't fit the schema."""


class PagingError(EngineError):
    """row_limit and threshold admit no page."""


class ApiError(EngineError):
    """Base of the request layer's errors; `code` names the variant."""

    code = "Unknown"


class CatalogApiError(ApiError):
    code = "CatalogError"


class ColumnNameCannotBeEmpty(ApiError):
    code = "ColumnNameCannotBeEmpty"


class ColumnNameAlreadyExists(ApiError):
    code = "ColumnNameAlreadyExists"


class ColumnIdAlreadyExists(ApiError):
    code = "ColumnIdAlreadyExists"


class NoData(ApiError):
    code = "NoData"


class InconsistentData(ApiError):
    code = "InconsistentData"


class InvalidScanRequest(ApiError):
    code = "InvalidScanRequest"
