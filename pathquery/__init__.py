"""A catalogue of files and directories as DataFrames, and a search-box language over it that compiles to Catalyst expressions."""


class PathQueryError(Exception):
    """Base of this package's errors."""


class QueryError(PathQueryError):
    """A query text that can't be understood."""


class CatalogError(PathQueryError):
    """A catalogue or change stream that is not consistent."""
