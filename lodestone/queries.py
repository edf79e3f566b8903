"""The queries of the library, by name, and their SQL where SQL can say the same."""

from lodestone.plans import answers, loads, orders, programs, questions, relations, retrieval, rules, streams, texts  # noqa: F401
from lodestone.registry import ORACLE_SQL, QUERIES  # noqa: F401
