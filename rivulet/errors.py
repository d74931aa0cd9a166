class QueryError(ValueError):
    """A statement that can't be parsed or analysed."""
