"""No SQL answer: the chain is checked operator by operator and on golden pages."""

SQL: dict[str, str] = {}
