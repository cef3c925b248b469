"""Statements and expressions of the dialect."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Name:
    column: str
    table: str | None = None


@dataclass(frozen=True)
class Literal:
    text: str
    kind: str  # "int", "string" or "bool"


@dataclass(frozen=True)
class Compare:
    op: str
    left: Name | Literal
    right: Name | Literal


@dataclass(frozen=True)
class Logic:
    op: str  # "and" or "or"
    left: Expr
    right: Expr


Expr = Compare | Logic


@dataclass(frozen=True)
class Select:
    tables: tuple[str, ...]
    where: Expr | None


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Assignment:
    target: Name
    value: Literal
    source: Name | None = None  # of `target = source op value`
    op: str | None = None


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[Assignment, ...]
    where: Expr


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class CreateIndex:
    table: str
    column: str


@dataclass(frozen=True)
class Load:
    path: str
    table: str


@dataclass(frozen=True)
class Run:
    path: str


@dataclass(frozen=True)
class Show:
    pass


Statement = Select | Insert | Update | Delete | CreateTable | CreateIndex | Load | Run | Show
