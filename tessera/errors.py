"""What can go wrong. The text after the colon is part of the dialect."""


class TesseraError(Exception):
    text = ""

    def __init__(self, detail: str = "") -> None:
        super().__init__("tessera: " + ": ".join(x for x in (self.text, detail) if x))


class SyntaxFault(TesseraError):
    def __init__(self, message: str, line: int, column: int) -> None:
        super().__init__(f"syntax error at line {line}, column {column}: {message}")
        self.message, self.line, self.column = message, line, column


class PlanError(TesseraError):
    pass


class TableNotFound(TesseraError):
    text = "no such table"


class TableExists(TesseraError):
    text = "table already exists"


class IndexNotFound(TesseraError):
    text = "no such index"


class IndexExists(TesseraError):
    text = "index already exists"


class ColumnNotFound(TesseraError):
    text = "no such column"


class NoPrimaryKey(TesseraError):
    text = "table needs exactly one PRIMARY KEY column"


class CorruptCatalog(TesseraError):
    text = "corrupt catalog entry"


class DuplicateKey(TesseraError):
    text = "duplicate primary key"


class NotNullViolated(TesseraError):
    text = "NOT NULL constraint violated"


class NullKey(TesseraError):
    text = "primary key must not be NULL"


class TypeMismatch(TesseraError):
    text = "type mismatch"


class DivideByZero(TesseraError):
    text = "division by zero"


class NoTransaction(TesseraError):
    text = "no transaction is open"


class TransactionOpen(TesseraError):
    text = "a transaction is already open"


class DDLInTransaction(TesseraError):
    text = "DDL is not allowed inside a transaction"


class ReadOnly(TesseraError):
    text = "registered tables are read-only"


class Unsupported(TesseraError):
    text = "unsupported statement"


class Busy(TesseraError):
    text = "another writer holds the database"
