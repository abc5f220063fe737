"""Functions of PostgreSQL-flavoured SQL that Spark calls otherwise, as SQL functions that the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

# name: (parameters, result, body)
SCALARS = {
    "strpos": ("s STRING, part STRING", "INT", "instr(s, part)"),
    "starts_with": ("s STRING, part STRING", "BOOLEAN", "startswith(s, part)"),
    "ends_with": ("s STRING, part STRING", "BOOLEAN", "endswith(s, part)"),
    "to_hex": ("x BIGINT", "STRING", "lower(hex(x))"),
    "sha256": ("s STRING", "STRING", "sha2(s, 256)"),
    "iszero": ("x DOUBLE", "BOOLEAN", "x = 0"),
    "to_unixtime": ("t TIMESTAMP", "BIGINT", "unix_timestamp(t)"),
    "regexp_match": ("s STRING, pattern STRING", "STRING", "regexp_extract(s, pattern, 0)"),
    "array_has": ("a ARRAY<STRING>, x STRING", "BOOLEAN", "array_contains(a, x)"),
    "array_to_string": ("a ARRAY<STRING>, sep STRING", "STRING", "array_join(a, sep)"),
    "array_length": ("a ARRAY<STRING>", "INT", "size(a)"),
    "date_bin_seconds": ("width BIGINT, t TIMESTAMP", "TIMESTAMP", "timestamp_seconds(unix_timestamp(t) - pmod(unix_timestamp(t), width))"),
    "gcd": ("a BIGINT, b BIGINT", "BIGINT", "abs(aggregate(sequence(1, 96), struct(a AS x, b AS y), (s, i) -> IF(s.y = 0, s, struct(s.y AS x, s.x % s.y AS y)), s -> s.x))"),
    "lcm": ("a BIGINT, b BIGINT", "BIGINT", "CASE WHEN a = 0 OR b = 0 THEN 0 ELSE abs(a div gcd(a, b) * b) END"),
    "digest": ("s STRING, method STRING", "STRING", "CASE lower(method) WHEN 'md5' THEN md5(s) WHEN 'sha224' THEN sha2(s, 224) WHEN 'sha256' THEN sha2(s, 256) WHEN 'sha384' THEN sha2(s, 384) WHEN 'sha512' THEN sha2(s, 512) END"),
}

def register(spark: SparkSession) -> list[str]:
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(SCALARS)
