"""What tables and indexes exist, in one immutable value that a snapshot can hold on to."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from ..errors import ColumnNotFound, CorruptCatalog, IndexExists, IndexNotFound, NoPrimaryKey, PlanError, TableExists, TableNotFound
from ..plans.kinds import Kind
from ..plans.nodes import ColumnDef, identifier
from .tables import Column


@dataclass(frozen=True)
class Index:
    name: str
    column: str


@dataclass(frozen=True)
class Entry:
    """A stored table: its schema and the data files of one version."""

    name: str
    id: int
    columns: tuple[Column, ...]
    indexes: tuple[Index, ...] = ()
    files: tuple[str, ...] = ()

    @property
    def key(self) -> Column:
        return next(c for c in self.columns if c.primary_key)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise ColumnNotFound(f"{self.name}.{name}")

    def sql(self) -> str:
        """Statements that make the table and its indexes again."""
        cols = ", ".join(f"{identifier(c.name)} {c.kind.value}" + (" PRIMARY KEY" if c.primary_key else " NOT NULL" if c.not_null else "") for c in self.columns)
        made = [f"CREATE TABLE {identifier(self.name)} ({cols});"]
        return "\n".join([*made, *(f"CREATE INDEX {identifier(i.name)} ON {identifier(self.name)} ({identifier(i.column)});" for i in self.indexes)])


@dataclass(frozen=True)
class Catalog:
    version: int = 0
    next_id: int = 1
    tables: dict[str, Entry] = field(default_factory=dict)

    def get(self, name: str) -> Entry:
        if name not in self.tables:
            raise TableNotFound(name)
        return self.tables[name]

    def has(self, name: str) -> bool:
        return name in self.tables

    def names(self) -> list[str]:
        return sorted(self.tables)

    def all(self) -> list[Entry]:
        return [self.tables[k] for k in self.names()]

    def find_index(self, name: str) -> tuple[Entry, Index]:
        for t in self.all():
            for i in t.indexes:
                if i.name == name:
                    return t, i
        raise IndexNotFound(name)

    def has_index(self, name: str) -> bool:
        return any(i.name == name for t in self.tables.values() for i in t.indexes)

    def with_table(self, entry: Entry) -> Catalog:
        return replace(self, tables=self.tables | {entry.name: entry})

    def create(self, name: str, defs: tuple[ColumnDef, ...]) -> Catalog:
        if self.has(name):
            raise TableExists(name)
        return replace(self.with_table(Entry(name, self.next_id, defined(name, defs))), next_id=self.next_id + 1)

    def drop(self, name: str) -> Catalog:
        self.get(name)
        return replace(self, tables={k: v for k, v in self.tables.items() if k != name})

    def add_index(self, name: str, table: str, column: str) -> Catalog:
        entry = self.get(table)
        entry.column(column)
        if self.has_index(name):
            raise IndexExists(name)
        return self.with_table(replace(entry, indexes=(*entry.indexes, Index(name, column))))

    def remove_index(self, name: str) -> Catalog:
        entry, index = self.find_index(name)
        return self.with_table(replace(entry, indexes=tuple(i for i in entry.indexes if i != index)))

    # -- as text ----------------------------------------------------------------------------

    def dumped(self) -> str:
        return json.dumps({"version": self.version, "next_id": self.next_id, "tables": [{"name": t.name, "id": t.id, "columns": [[c.name, c.kind.value, c.not_null, c.primary_key] for c in t.columns], "indexes": [[i.name, i.column] for i in t.indexes], "files": list(t.files)} for t in self.all()]}, indent=1)

    @staticmethod
    def loaded(text: str) -> Catalog:
        try:
            raw = json.loads(text)
            made = [Entry(t["name"], t["id"], tuple(Column(n, Kind(k), i, nn, pk) for i, (n, k, nn, pk) in enumerate(t["columns"])), tuple(Index(*i) for i in t["indexes"]), tuple(t["files"])) for t in raw["tables"]]
            return Catalog(raw["version"], raw["next_id"], {t.name: t for t in made})
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptCatalog(str(e)) from e


def defined(name: str, defs: tuple[ColumnDef, ...]) -> tuple[Column, ...]:
    seen: set[str] = set()
    for d in defs:
        if d.name in seen:
            raise PlanError(f'column "{d.name}" defined twice in table {name}')
        seen.add(d.name)
    if sum(d.primary_key for d in defs) != 1:
        raise NoPrimaryKey(name)
    return tuple(Column(d.name, d.kind, i, d.not_null or d.primary_key, d.primary_key) for i, d in enumerate(defs))
