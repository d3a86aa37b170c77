"""Exceptions raised on the driver."""

from __future__ import annotations


class MappingRequiredError(Exception):
    """Date, description or amount could not be found among the headers.

    ``columns`` holds the non-empty headers as they were read, so that the
    caller can offer them for an explicit mapping.
    """

    def __init__(self, columns: list[str]):
        self.columns = list(columns)
        super().__init__(f"Manual column mapping required; found {self.columns}")
