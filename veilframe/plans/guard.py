"""Second checks of a rendered query, by its text and by the host's parser.

Both hold for every query that ``sql.py`` renders; a query that fails one is
refused, whatever the renderer did wrong.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import SparkSession

from ..errors import ExecutionBackendError, PrivacyConstraintError, QueryParseError

_QUIET = re.compile(r"'(?:[^'\\]|\\.)*'|/\*\+ [\w (),]* \*/")
_LOUD = re.compile(r"--|/\*|\*/|\$\{|[;`\"'\n\r]")
_RELATION = re.compile(r"'?UnresolvedRelation \[([^\]]*)\]")


def check_text(sql: str) -> None:
    """No comment, statement end, variable or open quote outside of literals
    and hints."""
    if "${" in sql or _LOUD.search(_QUIET.sub(" ", sql)):
        raise QueryParseError("the query holds text that cannot be rendered safely")


def check_relations(spark: SparkSession, sql: str, known: list[str]) -> None:
    """The host reads exactly the relations that were parsed, as often."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
    except Exception as e:
        raise ExecutionBackendError("the query could not be parsed", cause=e) from None
    found = Counter(x.replace(", ", ".").lower() for x in _RELATION.findall(plan))
    if found != Counter(x.lower() for x in known):
        raise PrivacyConstraintError("the query reads relations that were not checked")
