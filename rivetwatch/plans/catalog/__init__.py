"""Registered queries: each is an operator run on whole tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from .registry import Query, all_queries  # noqa: F401
