"""Roles, scopes of collections, and rates."""

from __future__ import annotations

import time
from enum import IntEnum
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class Role(IntEnum):
    READ = 1
    WRITE = 2
    ADMIN = 3


_NEEDS = {
    Role.READ: {"search", "get", "list_collections", "collection_info", "stats", "total_memory_bytes"},
    Role.WRITE: {"create_collection", "delete_collection", "insert", "batch_insert", "update", "delete", "clear", "save", "load"},
}


def required_role(operation: str) -> Role:
    """The least role for an operation; what is not known needs an admin."""
    return next((role for role, names in _NEEDS.items() if operation in names), Role.ADMIN)


def allowed(role: Role, operation: str) -> bool:
    return role >= required_role(operation)


def matches(patterns: list[str] | None, name: str, role: Role = Role.READ) -> bool:
    """Whether a key with these patterns may see a collection: equal, or a prefix before ``*``. None and admins see all."""
    if patterns is None or role is Role.ADMIN:
        return True
    return any(name.startswith(p[:-1]) if p.endswith("*") else name == p for p in patterns)


def scope(name: Column, patterns: list[str]) -> Column:
    """The same as a predicate on a column of names."""
    return reduce(lambda a, b: a | b, [name.startswith(p[:-1]) if p.endswith("*") else name == p for p in patterns], F.lit(False))


def mask(key: str) -> str:
    return "***" if len(key) <= 8 else f"{key[:8]}..."


class TokenBucket:
    """``rate`` requests a second, at most ``rate`` at once."""

    def __init__(self, rate: float, clock=time.monotonic):
        self.rate, self.clock, self.tokens, self.at = rate, clock, float(rate), clock()

    def take(self) -> bool:
        now = self.clock()
        self.tokens, self.at = min(self.rate, self.tokens + (now - self.at) * self.rate), now
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True
