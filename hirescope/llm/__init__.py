"""Operators for preparing training data, and their registered queries."""

from __future__ import annotations


def queries() -> dict:
    from hirescope.llm.registered import queries as found

    return found()


def checks() -> dict[str, str]:
    from hirescope.llm.registered import checks as found

    return found()
