"""The key/value dialect over tables of (key, value) text.

SELECT * | KEY | VALUE | COUNT(*) | SUM(VALUE) ... FROM t [KEY 'k'] [WHERE ...] [GROUP BY VALUE] [ORDER BY KEY|VALUE [DESC]] [LIMIT n] [OFFSET n]
SELECT ... FROM a JOIN b ON KEY = KEY; UPSERT INTO t KEY 'k' VALUE 'v'; INSERT INTO t KEY 'k' VALUE 'v'; UPDATE t KEY 'k' SET VALUE 'v'; DELETE FROM t KEY 'k'

A statement becomes a DataFrame; nothing is run. Changes return the table after.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.text import compare
from heddle.operators.dml import insert, upsert
from heddle.operators.relational import lenient_avg, lenient_extreme, lenient_sum

MAX_TEXT, MAX_TOKENS, MAX_PAGE = 1 << 20, 65_536, 10_000
_TOKEN = re.compile(r"\s*(?:('(?:[^']|'')*')|(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(<>|!=|<=|>=|[=<>(),*]))")


class SyntaxProblem(ValueError):
    """A statement that isn't of the dialect."""


def tokenize(text: str) -> list[tuple[str, str]]:
    if len(text.encode()) > MAX_TEXT:
        raise SyntaxProblem("statement too long")
    out, at, text = [], 0, text.strip().rstrip(";")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(text[at : at + 20])
        kind = ("text", "number", "word", "sign")[m.lastindex - 1]
        out.append((kind, m[1][1:-1].replace("''", "'") if kind == "text" else m[m.lastindex]))
        at = m.end()
        if len(out) > MAX_TOKENS:
            raise SyntaxProblem("too many tokens")
    return out


@dataclass
class Parser:
    """One statement's tokens, read from the left."""

    tokens: list[tuple[str, str]]
    tables: dict[str, DataFrame]
    at: int = 0
    joined: bool = field(default=False)

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1].upper() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def want(self, *words: str) -> str:
        if not self.peek(*words):
            raise SyntaxProblem(f"expected {' or '.join(words)}")
        self.at += 1
        return self.tokens[self.at - 1][1].upper()

    def any(self, *kinds: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] not in kinds:
            raise SyntaxProblem(f"expected {' or '.join(kinds)}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def table(self) -> tuple[str, DataFrame]:
        name = self.any("word")
        if name not in self.tables:
            raise SyntaxProblem(f"no table {name}")
        return name, self.tables[name]

    def statement(self) -> DataFrame:
        verb = self.want("SELECT", "UPSERT", "INSERT", "UPDATE", "DELETE")
        out = getattr(self, f"_{verb.lower()}")()
        if self.at != len(self.tokens):
            raise SyntaxProblem(f"unexpected {self.tokens[self.at][1]}")
        return out

    def _pair(self, df: DataFrame) -> DataFrame:
        self.want("KEY")
        key = self.any("text")
        self.take("SET")
        self.want("VALUE")
        return df.sparkSession.createDataFrame([(key, self.any("text", "number"))], "key string, value string")

    def _upsert(self) -> DataFrame:
        self.want("INTO")
        df = self.table()[1]
        return upsert(df, self._pair(df), ["key"])

    def _insert(self) -> DataFrame:
        self.want("INTO")
        df = self.table()[1]
        return insert(df, self._pair(df), ["key"])

    def _update(self) -> DataFrame:
        df = self.table()[1]
        row = self._pair(df).first()
        return df.withColumn("value", F.when(F.col("key") == row.key, F.lit(row.value)).otherwise(F.col("value")))

    def _delete(self) -> DataFrame:
        self.want("FROM")
        df = self.table()[1]
        if self.take("WHERE"):
            return df.where(~F.coalesce(self._or(), F.lit(False)))
        self.want("KEY")
        return df.where(F.col("key") != self.any("text"))

    def _item(self) -> tuple[str, Column | None, bool]:
        """(name, column or None for *, if it is an aggregate)."""
        if self.take("*"):
            return "*", None, False
        name = self.any("word")
        if self.peek("("):
            self.want("(")
            what = F.lit(1) if self.take("*") else F.col(self.want("KEY", "VALUE").lower())
            self.want(")")
            made = {"COUNT": F.count, "SUM": lenient_sum, "AVG": lenient_avg, "MIN": lambda c: lenient_extreme(c, False), "MAX": lenient_extreme}
            if name.upper() not in made:
                raise SyntaxProblem(name)
            item = (name.lower(), made[name.upper()](what), True)
        elif name.upper() in ("KEY", "VALUE"):
            item = (name.lower(), F.col(name.lower()), False)
        else:
            raise SyntaxProblem(name)
        return (self.any("word"), *item[1:]) if self.take("AS") else item

    def _select(self) -> DataFrame:
        items = [self._item()]
        while self.take(","):
            items.append(self._item())
        self.want("FROM")
        name, df = self.table()
        df = df.select("key", "value")
        if self.take("JOIN"):
            other, right = self.table()
            self.want("ON"), self.want("KEY"), self.want("="), self.want("KEY")
            df = df.withColumnRenamed("value", f"{name}_value").join(right.select("key", F.col("value").alias(f"{other}_value")), "key")
            self.joined = True
        if self.take("KEY"):
            df = df.where(F.col("key") == self.any("text"))
        if self.take("WHERE"):
            df = df.where(self._or())
        grouped = False
        if self.take("GROUP"):
            self.want("BY")
            by = self.want("KEY", "VALUE").lower()
            grouped = True
            df = df.groupBy(by).agg(*[c.alias(n) for n, c, agg in items if agg])
            df = df.select(*[n if agg else F.col(by).alias(n) for n, _, agg in items])
        elif any(agg for _, _, agg in items):
            df = df.agg(*[c.alias(n) for n, c, _ in items])
            grouped = True
        if self.take("ORDER"):
            self.want("BY")
            c = F.col(self.any("word").lower())
            down = self.take("DESC")
            self.take("ASC")
            df = df.orderBy(c.desc_nulls_first() if down else c.asc_nulls_last())
        limit = int(self.any("number")) if self.take("LIMIT") else None
        if self.take("OFFSET"):
            df = df.offset(self._bounded(int(self.any("number"))))
        if limit is not None:
            df = df.limit(self._bounded(limit))
        if grouped or any(n == "*" for n, _, _ in items):
            return df
        return df.select(*[c.alias(n) for n, c, _ in items])

    @staticmethod
    def _bounded(n: int) -> int:
        if n > MAX_PAGE:
            raise SyntaxProblem(f"at most {MAX_PAGE}")
        return n

    def _or(self) -> Column:
        out = self._and()
        while self.take("OR"):
            out = out | self._and()
        return out

    def _and(self) -> Column:
        out = self._term()
        while self.take("AND"):
            out = out & self._term()
        return out

    def _term(self) -> Column:
        if self.take("NOT"):
            return ~self._term()
        if self.take("("):
            out = self._or()
            self.want(")")
            return out
        c = F.col(self.want("KEY", "VALUE").lower())
        if self.take("CONTAINS"):
            return c.contains(self.any("text"))
        if self.take("IS"):
            negated = self.take("NOT")
            self.want("NULL")
            return c.isNotNull() if negated else c.isNull()
        negated = self.take("NOT")
        if self.take("LIKE", "ILIKE"):
            word = self.tokens[self.at - 1][1].lower()
            out = getattr(c, word)(self.any("text"))
        elif self.take("IN"):
            self.want("(")
            values = [self.any("text", "number")]
            while self.take(","):
                values.append(self.any("text", "number"))
            self.want(")")
            out = c.isin(*values)
        elif self.take("BETWEEN"):
            low = self.any("text", "number")
            self.want("AND")
            out = compare(c, ">=", F.lit(low)) & compare(c, "<=", F.lit(self.any("text", "number")))
        else:
            sign = self.want("=", "<>", "!=", "<", "<=", ">", ">=")
            out = compare(c, "<>" if sign == "!=" else sign, F.lit(self.any("text", "number")))
        return ~out if negated else out


def run(sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The DataFrame of one statement."""
    return Parser(tokenize(sql), tables).statement()


def explain(sql: str, tables: dict[str, DataFrame]) -> str:
    """The access path of a statement: point_lookup, filtered_scan with its number of conditions, or scan."""
    words = [t[1].upper() if t[0] != "text" else "" for t in tokenize(sql)]
    run(sql, tables)
    if "WHERE" in words:
        rest = words[words.index("WHERE") :]
        return f"filtered_scan filters {1 + rest.count('AND') - rest.count('BETWEEN') + rest.count('OR')}"
    after = words.index("FROM") + 2 if "FROM" in words else len(words)
    return "point_lookup" if words[after : after + 1] == ["KEY"] else "scan"
