"""Operators that a training-data pipeline needs; nothing else in the library imports them."""


def queries() -> dict:
    """One query for each operator."""
    from codeloom.llm import registry

    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    from codeloom.llm import registry

    return registry.ORACLE_SQL
