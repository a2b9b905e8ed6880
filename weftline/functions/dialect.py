"""Expressions that must mean the same in Spark SQL and in the SQL they are checked against.

Each builder gives the text of an expression in one of the two dialects.
"""

from __future__ import annotations

import re


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def text(self, s: str) -> str:
        s = s.replace("'", "\\x27") if self.spark and "\\" in s else s.replace("'", "''")
        return f"r'{s}'" if self.spark and "\\" in s else f"'{s}'"

    def has(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.text(pattern)})" if self.spark else f"regexp_matches({x}, {self.text(pattern)})"

    def holds(self, x: str, word: str) -> str:
        return f"contains({x}, {self.text(word)})"

    def word(self, x: str, word: str) -> str:
        return self.has(x, rf"\b{re.escape(word)}\b".replace("\\ ", " "))

    def get(self, x: str, pattern: str, group: int = 1) -> str:
        return f"nullif(regexp_extract({x}, {self.text(pattern)}, {group}), '')"

    def all(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, {group})"

    def sub(self, x: str, pattern: str, put: str) -> str:
        if self.spark:
            put = re.sub(r"\\(\d)", r"$\1", put)
            return f"regexp_replace({x}, {self.text(pattern)}, {self.text(put)})"
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(put)}, 'g')"

    def cases(self, pairs: list[tuple[str, str]], other: str = "NULL") -> str:
        return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {other} END"

    def sorted_distinct(self, x: str) -> str:
        return f"array_sort(array_distinct({x}))" if self.spark else f"list_sort(list_distinct({x}))"

    def join(self, x: str, by: str) -> str:
        return f"array_join({x}, '{by}')" if self.spark else f"array_to_string({x}, '{by}')"

    def each(self, x: str, f) -> str:
        return f"transform({x}, v -> {f('v')})" if self.spark else f"list_transform({x}, lambda v: {f('v')})"

    def keep(self, x: str, f) -> str:
        return f"filter({x}, v -> {f('v')})" if self.spark else f"list_filter({x}, lambda v: {f('v')})"


SPARK, DUCK = Dialect(True), Dialect(False)
