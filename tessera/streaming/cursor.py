"""A result read row by row, on the snapshot it began with."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..errors import TesseraError


class Rows:
    def __init__(self, frame: DataFrame, columns: list[str], translate) -> None:
        self.columns, self.err = columns, None
        self._translate, self._row = translate, None
        self._left: Iterator = iter(())
        self._frame: DataFrame | None = frame
        self._started = False

    def next(self) -> bool:
        """Steps to the next row; False at the end, after an error or once closed."""
        if self._frame is None or self.err:
            return False
        try:
            if not self._started:
                self._left, self._started = self._frame.toLocalIterator(), True
            self._row = tuple(next(self._left))
            return True
        except StopIteration:
            self.close()
        except Exception as e:  # noqa: BLE001 - kept for the reader, as its kind of error
            self.err = self._translate(e)
        return False

    def row(self) -> tuple:
        return self._row

    def close(self) -> None:
        self._frame, self._left = None, iter(())

    def __iter__(self) -> Iterator[tuple]:
        while self.next():
            yield self._row
        if isinstance(self.err, TesseraError):
            raise self.err

    def __enter__(self) -> Rows:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
