"""The few expressions that Spark SQL and the checking engine (DuckDB) spell differently."""

from __future__ import annotations


class Spark:
    """Expressions as Spark SQL; everything here compiles into the plan, but for ``jw`` (an Arrow UDF)."""

    name = "spark"
    layered = False  # steps of long computations as nested SELECTs, see functions/sphere.py

    string = "string"
    quote = "char(39)"
    moment = "timestamp_ntz"
    source, of = " AS t", "t."  # in an ORDER BY, Spark takes a result column before the source's column of that name

    @staticmethod
    def newest(value: str, *by: str) -> str:
        """The value of the row that is last in the order of some columns."""
        return f"max_by({value}, struct({', '.join(by)}))"

    @staticmethod
    def seconds_before(moment: str, n: str) -> str:
        return f"timestampadd(SECOND, -({n}), {moment})"

    @staticmethod
    def unit(v: str) -> str:
        """The vector as doubles of length 1; the length is taken once. NULL for a vector of zeros."""
        norm = f"sqrt(aggregate({v}, cast(0 AS double), (s, x) -> s + cast(x AS double) * cast(x AS double)))"
        return f"transform(array({norm}), n -> IF(n > 0, transform({v}, x -> cast(x AS double) / n), NULL))[0]"

    @staticmethod
    def pick(values: list, at: str) -> str:
        """The value at a position from 0; NULL beyond the list."""
        kind = "double" if isinstance(values[0], float) else "bigint" if max(map(abs, values)) > 1 << 30 else "int"
        return f"get(array({', '.join(f'cast({v!r} AS {kind})' if kind != 'int' else repr(v) for v in values)}), cast({at} AS int))"

    @staticmethod
    def numbered(n: int, name: str) -> str:
        return f"(SELECT cast(id AS int) AS {name} FROM range({n}))"

    @staticmethod
    def dot(a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), cast(0 AS double), (s, v) -> s + v)"

    @staticmethod
    def digits(x: str) -> str:
        return f"regexp_replace({x}, '[^0-9]', '')"

    @staticmethod
    def try_number(x: str) -> str:
        return f"try_cast({x} AS bigint)"

    @staticmethod
    def letter(x: str) -> str:
        return f"char(65 + {x})"

    @staticmethod
    def initcap(x: str) -> str:
        return f"initcap({x})"

    @staticmethod
    def jw(a: str, b: str) -> str:
        return f"jaro_winkler({a}, {b})"

    @staticmethod
    def hours(a: str, b: str) -> str:
        """Hour boundaries between two timestamps."""
        return f"((unix_seconds(cast(date_trunc('HOUR', {b}) AS timestamp)) - unix_seconds(cast(date_trunc('HOUR', {a}) AS timestamp))) div 3600)"

    @staticmethod
    def add_minutes(ts: str, n: str) -> str:
        return f"timestampadd(MINUTE, {n}, {ts})"

    @staticmethod
    def month(ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM')"

    @staticmethod
    def day(ts: str) -> str:
        return f"cast({ts} AS date)"

    @staticmethod
    def week(ts: str) -> str:
        return f"cast(date_trunc('WEEK', {ts}) AS date)"

    @staticmethod
    def quarter(ts: str) -> str:
        return f"concat(cast(year({ts}) AS string), '-Q', cast(quarter({ts}) AS string))"

    @staticmethod
    def sha(x: str) -> str:
        return f"sha2({x}, 256)"

    @staticmethod
    def hash_mod(x: str, n: int) -> str:
        """The first eight hex digits of the SHA-256 modulo n."""
        return f"pmod(cast(conv(substr(sha2({x}, 256), 1, 8), 16, 10) AS bigint), {n})"

    @staticmethod
    def text(x: str) -> str:
        return f"cast({x} AS string)"

    @staticmethod
    def grid(first: int, last: int, scale: str) -> str:
        """Thresholds first..last hundredths, as exact decimals turned into doubles."""
        return f"SELECT cast(cast(id AS decimal(10,2)) / 100 AS double) AS threshold FROM range({first}, {last + 1})"

    @staticmethod
    def lpad(x: str, n: int) -> str:
        return f"lpad(cast({x} AS string), {n}, '0')"

    @staticmethod
    def idiv(a: str, b: str) -> str:
        return f"({a} div {b})"

    @staticmethod
    def quantile_of(mart: str, x: str, where: str, p: float) -> str:
        """The exact quantile of a column, found before the query runs (operators/quantiles.py)."""
        return f"[[{mart}|{x}|{where}|{p}]]"

    @classmethod
    def quoted(cls, x: str) -> str:
        return f"concat({cls.quote}, replace({x}, {cls.quote}, concat({cls.quote}, {cls.quote})), {cls.quote})"

    @staticmethod
    def listagg(x: str) -> str:
        return f"listagg(DISTINCT {x}, ', ') WITHIN GROUP (ORDER BY {x})"

    @staticmethod
    def half_even(x: str) -> str:
        return f"bround({x})"

    any_least = staticmethod(lambda value, by: f"min_by({value}, {by})")


class Layered(Spark):
    layered = True


class Duck(Spark):
    name = "duck"
    layered = True

    @staticmethod
    def pick(values: list, at: str) -> str:
        kind = "DOUBLE" if isinstance(values[0], float) else "BIGINT"
        return f"([{', '.join(map(repr, values))}]::{kind}[])[({at})::INT + 1]"

    @staticmethod
    def numbered(n: int, name: str) -> str:
        return f"(SELECT range AS {name} FROM range({n})) AS n"

    string = "VARCHAR"
    quote = "chr(39)"
    moment = "TIMESTAMP"
    source, of = "", ""

    @staticmethod
    def newest(value: str, *by: str) -> str:
        return f"last({value} ORDER BY {', '.join(by)})"

    @staticmethod
    def seconds_before(moment: str, n: str) -> str:
        return f"({moment} - to_seconds({n}))"

    @staticmethod
    def unit(v: str) -> str:
        return f"{v}::DOUBLE[]"

    @staticmethod
    def dot(a: str, b: str) -> str:
        return f"list_cosine_similarity({a}, {b})"

    @staticmethod
    def digits(x: str) -> str:
        return f"regexp_replace({x}, '[^0-9]', '', 'g')"

    @staticmethod
    def letter(x: str) -> str:
        return f"chr((65 + {x})::INTEGER)"

    @staticmethod
    def initcap(x: str) -> str:
        return f"list_aggregate(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')"

    @staticmethod
    def jw(a: str, b: str) -> str:
        return f"jaro_winkler_similarity({a}, {b})"

    @staticmethod
    def hours(a: str, b: str) -> str:
        return f"datediff('hour', {a}, {b})"

    @staticmethod
    def add_minutes(ts: str, n: str) -> str:
        return f"({ts} + to_minutes({n}))"

    @staticmethod
    def month(ts: str) -> str:
        return f"strftime({ts}, '%Y-%m')"

    @staticmethod
    def week(ts: str) -> str:
        return f"cast(date_trunc('week', {ts}) AS date)"

    @staticmethod
    def quarter(ts: str) -> str:
        return f"(year({ts})::VARCHAR || '-Q' || quarter({ts})::VARCHAR)"

    @staticmethod
    def sha(x: str) -> str:
        return f"sha256({x})"

    @staticmethod
    def hash_mod(x: str, n: int) -> str:
        return f"(('0x' || substr(sha256({x}), 1, 8))::BIGINT % {n})"

    @staticmethod
    def text(x: str) -> str:
        return f"cast({x} AS VARCHAR)"

    @staticmethod
    def grid(first: int, last: int, scale: str) -> str:
        return f"SELECT cast(cast(range AS decimal(10,2)) / 100 AS double) AS threshold FROM range({first}, {last + 1})"

    @staticmethod
    def lpad(x: str, n: int) -> str:
        return f"lpad(cast({x} AS VARCHAR), {n}, '0')"

    @staticmethod
    def idiv(a: str, b: str) -> str:
        return f"({a} // {b})"

    @staticmethod
    def quantile_of(mart: str, x: str, where: str, p: float) -> str:
        return f"(SELECT quantile_cont({x}, {p}) FROM {{{mart}}} WHERE {where})"

    @staticmethod
    def listagg(x: str) -> str:
        return f"string_agg(DISTINCT {x}, ', ' ORDER BY {x})"

    @staticmethod
    def half_even(x: str) -> str:
        return f"round_even({x}, 0)"

    any_least = staticmethod(lambda value, by: f"arg_min({value}, {by})")


def written(d) -> type[Spark]:
    """The dialect for a mart that is written before it is read."""
    return Layered if d is Spark else d
