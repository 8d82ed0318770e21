"""One text of a query for two engines.

A query is a function of a dialect; Spark runs it as Spark SQL on views of the tables, and its DuckDB form is the oracle. The
dialects differ in the names of list, regular-expression and string functions alone.
"""

from __future__ import annotations

import re


class Spark:
    name = "spark"
    any_value = "first"

    def table(self, t):
        return f"${t}"

    def rx(self, p):
        return "r'" + p + "'"

    def words(self, c):
        return f"filter(split(trim({c}), r'[ \\t\\n\\x0b\\f\\r]+'), x -> x <> '')"

    def lines(self, c):
        return f"split({c}, r'\\n')"

    def each(self, a, x):
        return f"explode({a}) AS {x}"

    def each_at(self, a, pos, x):
        return f"posexplode({a}) AS ({pos}, {x})"

    def filter(self, a, x, body):
        return f"filter({a}, {x} -> {body})"

    def map(self, a, x, body):
        return f"transform({a}, {x} -> {body})"

    def all_of(self, a, x, body):
        return f"forall({a}, {x} -> {body})"

    def some_of(self, a, x, body):
        return f"exists({a}, {x} -> {body})"

    def size(self, a):
        return f"size({a})"

    def join(self, a, sep):
        return f"array_join({a}, '{sep}')"

    def distinct(self, a):
        return f"array_distinct({a})"

    def sorted(self, a):
        return f"array_sort({a})"

    def slice(self, a, start, n):
        return f"slice({a}, {start}, {n})"

    def at(self, a, k):
        return f"element_at({a}, {k})"

    def list(self, *xs):
        return f"array({', '.join(xs)})"

    def both(self, a, b):
        return f"array_intersect({a}, {b})"

    def has(self, a, x):
        return f"array_contains({a}, {x})"

    def sequence(self, a, b, step="1"):
        return f"sequence({a}, {b}, {step})"

    def rx_sub(self, c, p, r):
        return f"regexp_replace({c}, r'{p}', '{r.replace(chr(92), '$')}')"

    def rx_all(self, c, p):
        return f"regexp_extract_all({c}, r'{p}', 0)"

    def rx_has(self, c, p):
        return f"({c} RLIKE r'{p}')"

    def rx_get(self, c, p, g=0):
        return f"regexp_extract({c}, r'{p}', {g})"

    def dot(self, a, b):
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)"

    def ordered(self, x, key, sep):
        return f"array_join(transform(array_sort(collect_list(struct({key} AS k, {x} AS v))), e -> e.v), '{sep}')"

    def epoch(self, ts):
        return f"unix_micros(CAST({ts} AS TIMESTAMP)) / 1000000"

    def hour(self, ts):
        return f"CAST(date_trunc('hour', {ts}) AS TIMESTAMP_NTZ)"

    def days(self, d, n):
        return f"date_add({d}, {n})"

    def bit_or(self, x):
        return f"bit_or({x})"

    def at_least_count(self, cond):
        return f"count_if({cond})"

    def starts(self, c, p):
        return f"startswith({c}, {p})"

    def json_int(self, c, k):
        return f"CAST(get_json_object({c}, '$.{k}') AS BIGINT)"


class Duck(Spark):
    name = "duckdb"
    any_value = "any_value"

    def table(self, t):
        return t

    def rx(self, p):
        return f"'{p}'"

    def words(self, c):
        return f"list_filter(string_split_regex(trim({c}), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"

    def lines(self, c):
        return f"string_split({c}, chr(10))"

    def each(self, a, x):
        return f"unnest({a}) AS {x}"

    def each_at(self, a, pos, x):
        return f"unnest({a}) AS {x}, generate_subscripts({a}, 1) - 1 AS {pos}"

    def filter(self, a, x, body):
        return f"list_filter({a}, lambda {x}: {body})"

    def map(self, a, x, body):
        return f"list_transform({a}, lambda {x}: {body})"

    def all_of(self, a, x, body):
        return f"(len(list_filter({a}, lambda {x}: NOT ({body}))) = 0)"

    def some_of(self, a, x, body):
        return f"(len(list_filter({a}, lambda {x}: {body})) > 0)"

    def size(self, a):
        return f"len({a})"

    def join(self, a, sep):
        return f"array_to_string({a}, '{sep}')"

    def distinct(self, a):
        return f"list_distinct({a})"

    def sorted(self, a):
        return f"list_sort({a})"

    def slice(self, a, start, n):
        return f"list_slice({a}, {start}, {start} + {n} - 1)"

    def list(self, *xs):
        return f"[{', '.join(xs)}]"

    def at(self, a, k):
        return f"list_extract({a}, {k})"

    def both(self, a, b):
        return f"list_intersect({a}, {b})"

    def has(self, a, x):
        return f"list_contains({a}, {x})"

    def sequence(self, a, b, step="1"):
        return f"generate_series({a}, {b}, {step})"

    def rx_sub(self, c, p, r):
        return f"regexp_replace({c}, '{p}', '{r}', 'g')"

    def rx_all(self, c, p):
        return f"regexp_extract_all({c}, '{p}')"

    def rx_has(self, c, p):
        return f"regexp_matches({c}, '{p}')"

    def rx_get(self, c, p, g=0):
        return f"regexp_extract({c}, '{p}', {g})"

    def dot(self, a, b):
        return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def ordered(self, x, key, sep):
        return f"string_agg({x}, '{sep}' ORDER BY {key})"

    def epoch(self, ts):
        return f"epoch_us({ts}) / 1000000"

    def hour(self, ts):
        return f"date_trunc('hour', {ts})"

    def days(self, d, n):
        return f"({d} + CAST({n} AS INTEGER))"

    def bit_or(self, x):
        return f"bit_or({x})"

    def at_least_count(self, cond):
        return f"count(*) FILTER ({cond})"

    def starts(self, c, p):
        return f"starts_with({c}, {p})"

    def json_int(self, c, k):
        return f"CAST(json_extract_string({c}, '$.{k}') AS BIGINT)"


SPARK, DUCK = Spark(), Duck()
#: Tables whose rows take long to read word by word.
TEXTS = {"documents", "pages"}


def run(spark, sf_dir: str, text: str):
    """Run text with each $table as a view of that table in sf_dir."""
    import zlib

    tag = f"{zlib.crc32(sf_dir.encode()):08x}"
    for name in sorted(set(re.findall(r"\$([a-z]+)\b(?!\.)", text))):
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        cores = spark.sparkContext.defaultParallelism
        if name in TEXTS and len(table.inputFiles()) < cores:  # a few files of texts would leave most cores idle
            table = table.repartition(cores)
        table.createOrReplaceTempView(f"{name}_{tag}")
    return spark.sql(re.sub(r"\$([a-z]+)\b", lambda m: f"{m[1]}_{tag}", text))
