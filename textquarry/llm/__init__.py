"""Operators for preparing training data; nothing else in the library imports them."""


def queries() -> dict:
    """All pN_ queries."""
    from textquarry.llm import queries_neardup, queries_pii, queries_records, queries_tokens

    return {**queries_tokens.QUERIES, **queries_neardup.QUERIES, **queries_records.QUERIES, **queries_pii.QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    from textquarry.llm import queries_neardup, queries_pii, queries_records, queries_tokens

    return {**queries_tokens.SQL, **queries_neardup.SQL, **queries_records.SQL, **queries_pii.SQL}
