"""Names of the queries over the driver's tables, with their SQL counterparts."""

from __future__ import annotations

from . import bindings, programs
from .oracle import ORACLE as TABLES

ORACLE: dict[str, str] = {**TABLES, **programs.ORACLE}
QUERIES: dict = {name: getattr(bindings, name) for name in TABLES} | programs.QUERIES
