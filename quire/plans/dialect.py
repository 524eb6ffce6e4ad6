"""The few places where the engine's SQL and the oracle's SQL are spelled differently."""

from __future__ import annotations


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Spark:
    """Spark SQL; tables are read where ``sf_dir`` says, so scans prune columns and push filters."""

    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir

    def t(self, table: str) -> str:
        return f"parquet.`{self.sf_dir}/{table}.parquet`"

    def re(self, pattern: str) -> str:
        return 'r"' + pattern + '"' if "'" in pattern else "r'" + pattern + "'"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.re(pattern)}, {quoted(by)})"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.re(pattern)})"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, {self.re(pattern)}, {group})"

    def extract_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.re(pattern)}, {group})"

    def numbered(self, source: str, columns: str, items: str) -> str:
        """Rows (columns, ord from 0, item) of an array."""
        return f"(select {columns}, ord, item from {source} lateral view posexplode({items}) x as ord, item)"

    def fold_path(self, parts: str) -> str:
        kept = f"filter({parts}, s -> s <> '' and s <> '.')"
        return f"array_join(aggregate({kept}, cast(array() as array<string>), (a, s) -> if(s = '..', slice(a, 1, greatest(size(a) - 1, 0)), concat(a, array(s)))), '/')"

    def split(self, x: str, at: str) -> str:
        return f"split({x}, {self.re(at)}, -1)"

    def count_in(self, x: str, pattern: str) -> str:
        return f"cast(regexp_count({x}, {self.re(pattern)}) as bigint)"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def json(self, x: str, field: str) -> str:
        return f"get_json_object({x}, '$.{field}')"

    def arg_max(self, x: str, *by: str) -> str:
        return f"max_by({x}, struct({', '.join(by)}))"

    def seconds(self, x: str) -> str:
        return f"unix_timestamp({x})"

    def text(self, x: str) -> str:
        return f"cast({x} as string)"


class Duck(Spark):
    """DuckDB over views of the same names."""

    def __init__(self):
        super().__init__("")

    def t(self, table):
        return table

    def re(self, pattern):
        return quoted(pattern)

    def replace(self, x, pattern, by):
        return f"regexp_replace({x}, {self.re(pattern)}, {quoted(by)}, 'g')"

    def matches(self, x, pattern):
        return f"regexp_matches({x}, {self.re(pattern)})"

    def numbered(self, source, columns, items):
        return f"(select {columns}, (i - 1)::int as ord, l[i] as item from (select *, {items} as l from {source}), unnest(range(1, len(l) + 1)) as t(i))"

    def fold_path(self, parts):
        kept = f"list_transform(list_filter({parts}, lambda s: s <> '' and s <> '.'), lambda s: [s])"
        return f"array_to_string(list_reduce(list_prepend([]::varchar[], {kept}), lambda a, b: case when b[1] = '..' then a[1:len(a) - 1] else list_concat(a, b) end), '/')"

    def split(self, x, at):
        return f"string_split_regex({x}, {self.re(at)})"

    def count_in(self, x, pattern):
        return f"len(regexp_extract_all({x}, {self.re(pattern)}))"

    def sha256(self, x):
        return f"sha256({x})"

    def json(self, x, field):
        return f"json_extract_string({x}, '$.{field}')"

    def arg_max(self, x, *by):
        return f"arg_max({x}, row({', '.join(by)}))"

    def seconds(self, x):
        return f"floor(epoch({x}))::bigint"

    def text(self, x):
        return f"cast({x} as varchar)"
