"""Scalar, array, map, JSON, XML, date and hash functions, several to a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.registry import Registry
from quarry.session import load

R = Registry()

R.sql(
    "fn_string_case",
    "SELECT p_partkey, upper(p_name) AS u, lower(p_name) AS l, initcap(p_name) AS i, length(p_name) AS n, char_length(p_name) AS cl, octet_length(p_name) AS ol, bit_length(p_name) AS bl, ascii(p_name) AS a, reverse(p_name) AS r, ucase(p_brand) AS uc, lcase(p_brand) AS lc FROM part",
    "SELECT p_partkey, upper(p_name) AS u, lower(p_name) AS l, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS i, length(p_name)::INTEGER AS n, length(p_name)::INTEGER AS cl, octet_length(encode(p_name))::INTEGER AS ol, (octet_length(encode(p_name)) * 8)::INTEGER AS bl, ascii(p_name) AS a, reverse(p_name) AS r, upper(p_brand) AS uc, lower(p_brand) AS lc FROM part",
)
R.sql(
    "fn_string_cut",
    "SELECT p_partkey, substring(p_name, 2, 4) AS s, substr(p_name, -3) AS t, left(p_name, 3) AS le, right(p_name, 2) AS ri, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, trim('  x ') AS tr, ltrim('  x') AS lt, rtrim('x  ') AS rt, trim(BOTH 'B' FROM p_brand) AS tb, repeat('ab', 3) AS re, space(2) AS sp, concat(p_brand, '/', p_type) AS co, concat_ws('-', p_brand, p_type) AS cw FROM part",
    "SELECT p_partkey, substring(p_name, 2, 4) AS s, substr(p_name, -3) AS t, left(p_name, 3) AS le, right(p_name, 2) AS ri, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, trim('  x ') AS tr, ltrim('  x') AS lt, rtrim('x  ') AS rt, trim(p_brand, 'B') AS tb, repeat('ab', 3) AS re, repeat(' ', 2) AS sp, concat(p_brand, '/', p_type) AS co, concat_ws('-', p_brand, p_type) AS cw FROM part",
)
R.sql(
    "fn_string_find",
    "SELECT p_partkey, instr(p_type, 'E') AS i, locate('E', p_type, 3) AS lo, position('A' IN p_type) AS po, find_in_set(p_brand, 'Brand#11,Brand#12') AS f, translate(p_brand, '#B', '_b') AS tr, replace(p_type, 'A', '@') AS re, p_type LIKE '%S_E%' AS li, elt(2, p_brand, p_type) AS el, split(p_type, ' ')[0] AS sp, substring_index(p_type, ' ', 1) AS si FROM part",
    "SELECT p_partkey, instr(p_type, 'E')::INTEGER AS i, CASE WHEN instr(substr(p_type, 3), 'E') = 0 THEN 0 ELSE instr(substr(p_type, 3), 'E') + 2 END::INTEGER AS lo, position('A' IN p_type)::INTEGER AS po, coalesce(list_position(['Brand#11', 'Brand#12'], p_brand), 0)::INTEGER AS f, translate(p_brand, '#B', '_b') AS tr, replace(p_type, 'A', '@') AS re, p_type LIKE '%S_E%' AS li, p_type AS el, string_split(p_type, ' ')[1] AS sp, string_split(p_type, ' ')[1] AS si FROM part",
)
R.sql(
    "fn_string_format",
    "SELECT r_regionkey, format_string('%s-%d', r_name, r_regionkey) AS fs, printf('%05d', r_regionkey) AS pf, format_number(1234567.891, 2) AS fn, base64(encode(r_name, 'utf-8')) AS b, decode(unbase64(base64(encode(r_name, 'utf-8'))), 'utf-8') AS ub, hex(r_name) AS h, decode(unhex(hex(r_name)), 'utf-8') AS uh, soundex('Robert') AS sx, levenshtein('kitten', 'sitting') AS lv, chr(65 + r_regionkey) AS ch FROM region",
    "SELECT r_regionkey, r_name || '-' || r_regionkey AS fs, lpad(r_regionkey::VARCHAR, 5, '0') AS pf, '1,234,567.89' AS fn, base64(encode(r_name)) AS b, r_name AS ub, hex(r_name) AS h, r_name AS uh, 'R163' AS sx, levenshtein('kitten', 'sitting')::INTEGER AS lv, chr(65 + r_regionkey) AS ch FROM region",
)
R.sql(
    "fn_regex",
    r"SELECT p_partkey, regexp_extract(p_brand, '#([0-9])([0-9])', 2) AS x, regexp_replace(p_type, '[AEIOU]', '.') AS r, p_type RLIKE '^[S-Z]' AS m, size(split(p_type, '[ ]+')) AS n FROM part",
    r"SELECT p_partkey, regexp_extract(p_brand, '#([0-9])([0-9])', 2) AS x, regexp_replace(p_type, '[AEIOU]', '.', 'g') AS r, regexp_matches(p_type, '^[S-Z]') AS m, len(regexp_split_to_array(p_type, '[ ]+'))::INTEGER AS n FROM part",
)
R.sql(
    "fn_url",
    "SELECT page_id, parse_url(url, 'HOST') AS h, parse_url(url, 'PROTOCOL') AS p, try_parse_url(url, 'QUERY') AS q FROM pages",
    "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^([a-z]+)://', 1) AS p, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS q FROM pages",
)
R.sql("fn_sentences", "SELECT size(sentences('One two. Three four five! Six.')) AS n, sentences('One two. Three.')[0][1] AS w", "SELECT 3 AS n, 'two' AS w")
R.sql(
    "fn_date_parts",
    "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofmonth(o_orderdate) AS dm, dayofyear(o_orderdate) AS dy, dayofweek(o_orderdate) AS dw, weekday(o_orderdate) AS wd, weekofyear(o_orderdate) AS wy, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, extract(YEAR FROM o_orderdate) AS ey FROM orders",
    "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, quarter(o_orderdate)::INTEGER AS q, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d, day(o_orderdate)::INTEGER AS dm, dayofyear(o_orderdate)::INTEGER AS dy, (dayofweek(o_orderdate) + 1)::INTEGER AS dw, (isodow(o_orderdate) - 1)::INTEGER AS wd, weekofyear(o_orderdate)::INTEGER AS wy, hour(o_orderdate)::INTEGER AS h, minute(o_orderdate)::INTEGER AS mi, year(o_orderdate)::INTEGER AS ey FROM orders",
)
R.sql(
    "fn_date_math",
    "SELECT o_orderkey, CAST(date_add(o_orderdate, 10) AS STRING) AS a, CAST(date_sub(o_orderdate, 10) AS STRING) AS s, datediff(o_orderdate, DATE '1992-01-01') AS n, CAST(add_months(o_orderdate, 2) AS STRING) AS am, CAST(last_day(o_orderdate) AS STRING) AS ld, CAST(trunc(o_orderdate, 'MM') AS STRING) AS tm, CAST(trunc(o_orderdate, 'YEAR') AS STRING) AS ty, date_format(o_orderdate, 'yyyy/MM/dd') AS f, CAST(next_day(o_orderdate, 'Mon') AS STRING) AS nd FROM orders",
    "SELECT o_orderkey, (o_orderdate::DATE + 10)::VARCHAR AS a, (o_orderdate::DATE - 10)::VARCHAR AS s, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INTEGER AS n, (o_orderdate::DATE + INTERVAL 2 MONTH)::DATE::VARCHAR AS am, last_day(o_orderdate::DATE)::VARCHAR AS ld, date_trunc('month', o_orderdate)::DATE::VARCHAR AS tm, date_trunc('year', o_orderdate)::DATE::VARCHAR AS ty, strftime(o_orderdate, '%Y/%m/%d') AS f, (o_orderdate::DATE + (8 - isodow(o_orderdate))::INTEGER)::VARCHAR AS nd FROM orders",
)
R.sql(
    "fn_date_parse",
    "SELECT CAST(to_date('2016-12-31') AS STRING) AS d, CAST(to_date('31/12/2016', 'dd/MM/yyyy') AS STRING) AS df, CAST(to_timestamp('2016-12-31 00:12:00') AS STRING) AS t, unix_timestamp('2019-09-09', 'yyyy-MM-dd') AS u, to_unix_timestamp('1970-01-02', 'yyyy-MM-dd') AS tu, from_unixtime(86400, 'yyyy-MM-dd') AS f, CAST(from_utc_timestamp('2016-08-31', 'Asia/Seoul') AS STRING) AS fu, CAST(to_utc_timestamp('2016-08-31', 'Asia/Seoul') AS STRING) AS tut, current_date() = to_date(now()) AS cd, current_timestamp() = now() AS ct, months_between('1997-02-28', '1996-02-28') AS mb, second(to_timestamp('2016-12-31 00:12:09')) AS s",
    "SELECT '2016-12-31' AS d, '2016-12-31' AS df, '2016-12-31 00:12:00' AS t, 1567987200::BIGINT AS u, 86400::BIGINT AS tu, '1970-01-02' AS f, '2016-08-31 09:00:00' AS fu, '2016-08-30 15:00:00' AS tut, true AS cd, true AS ct, 12.0::DOUBLE AS mb, 9 AS s",
)
R.sql(
    "fn_math",
    "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS ab, ceil(l_extendedprice) AS ce, floor(l_extendedprice) AS fl, round(l_tax * 7, 3) AS ro, sign(l_quantity - 25) AS si, round(sqrt(l_quantity), 9) AS sq, round(exp(l_tax), 9) AS ex, round(ln(l_quantity), 9) AS ln, round(log10(l_quantity), 9) AS l10, round(log2(l_quantity), 9) AS l2, round(pow(l_quantity, 2), 6) AS po, round(cbrt(l_quantity), 9) AS cb, greatest(l_quantity, 20) AS gr, least(l_quantity, 20) AS le FROM lineitem",
    "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS ab, ceil(l_extendedprice)::BIGINT AS ce, floor(l_extendedprice)::BIGINT AS fl, round(l_tax * 7, 3) AS ro, sign(l_quantity - 25)::DOUBLE AS si, round(sqrt(l_quantity), 9) AS sq, round(exp(l_tax), 9) AS ex, round(ln(l_quantity), 9) AS ln, round(log10(l_quantity), 9) AS l10, round(log2(l_quantity), 9) AS l2, round(pow(l_quantity, 2), 6) AS po, round(cbrt(l_quantity), 9) AS cb, greatest(l_quantity, 20) AS gr, least(l_quantity, 20) AS le FROM lineitem",
)
R.sql(
    "fn_trig",
    "SELECT id, round(sin(id), 9) AS s, round(cos(id), 9) AS c, round(tan(id), 9) AS t, round(cot(id + 1), 9) AS ct, round(asin(id / 10.0D), 9) AS a, round(acos(id / 10.0D), 9) AS ac, round(atan(id), 9) AS at, round(atan2(id, 2), 9) AS a2, round(degrees(id), 6) AS de, round(radians(id), 9) AS ra, round(pi(), 9) AS p, round(sinh(id), 6) AS sh, round(hypot(id, 3), 9) AS hy FROM range(0, 10)",
    "SELECT range AS id, round(sin(range), 9) AS s, round(cos(range), 9) AS c, round(tan(range), 9) AS t, round(cot(range + 1), 9) AS ct, round(asin(range / 10.0::DOUBLE), 9) AS a, round(acos(range / 10.0::DOUBLE), 9) AS ac, round(atan(range), 9) AS at, round(atan2(range, 2), 9) AS a2, round(degrees(range), 6) AS de, round(radians(range), 9) AS ra, round(pi(), 9) AS p, round(sinh(range), 6) AS sh, round(sqrt(range * range + 9.0::DOUBLE), 9) AS hy FROM range(0, 10)",
)
R.sql(
    "fn_integer",
    "SELECT o_orderkey, o_orderkey % 7 AS m, pmod(-o_orderkey, 7) AS pm, o_orderkey div 3 AS di, negative(o_orderkey) AS ne, positive(o_orderkey) AS po, bin(o_orderkey) AS b, hex(o_orderkey) AS h, conv(CAST(o_orderkey AS STRING), 10, 16) AS c, factorial(5) AS f, try_divide(o_orderkey, 0) AS td FROM orders",
    "SELECT o_orderkey, o_orderkey % 7 AS m, ((-o_orderkey % 7) + 7) % 7 AS pm, o_orderkey // 3 AS di, -o_orderkey AS ne, o_orderkey AS po, bin(o_orderkey) AS b, hex(o_orderkey) AS h, hex(o_orderkey) AS c, 120::BIGINT AS f, NULL::DOUBLE AS td FROM orders",
)
R.sql("fn_bitwise", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 12 AS o, o_orderkey ^ 12 AS x, ~o_orderkey AS n, shiftleft(o_orderkey, 2) AS l, shiftright(o_orderkey, 1) AS r FROM orders", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 12 AS o, xor(o_orderkey, 12) AS x, ~o_orderkey AS n, o_orderkey << 2 AS l, o_orderkey >> 1 AS r FROM orders")
R.sql(
    "fn_cond",
    "SELECT n_nationkey, if(n_regionkey > 2, 'hi', 'lo') AS i, ifnull(v, -1) AS f, nullif(n_regionkey, 0) AS nf, nvl(v, -2) AS nv, nvl2(v, 1, 2) AS n2, coalesce(v, n_nationkey) AS c, isnull(v) AS isn, isnotnull(v) AS nn, nanvl(CAST('NaN' AS DOUBLE), 3.0D) AS na, isnan(CAST('NaN' AS DOUBLE)) AS isna, assert_true(n_nationkey >= 0) IS NULL AS ok FROM (SELECT *, nullif(n_regionkey, 1) AS v FROM nation) x",
    "SELECT n_nationkey, if(n_regionkey > 2, 'hi', 'lo') AS i, ifnull(v, -1) AS f, nullif(n_regionkey, 0) AS nf, coalesce(v, -2) AS nv, CASE WHEN v IS NOT NULL THEN 1 ELSE 2 END AS n2, coalesce(v, n_nationkey) AS c, v IS NULL AS isn, v IS NOT NULL AS nn, 3.0::DOUBLE AS na, true AS isna, true AS ok FROM (SELECT *, nullif(n_regionkey, 1) AS v FROM nation) x",
)
R.sql(
    "fn_array",
    "SELECT n_nationkey, array_contains(a, 2) AS c, array_join(transform(a, x -> CAST(x AS STRING)), ',') AS j, size(a) AS n, sort_array(a, false)[0] AS top, array_max(a) AS mx, array_min(a) AS mn, array_position(a, 3) AS p, size(array_distinct(a)) AS d, element_at(a, -1) AS l, slice(a, 2, 2)[0] AS s, size(array_union(a, array(9))) AS u, size(array_intersect(a, array(1, 2))) AS it, size(array_except(a, array(1))) AS ex, arrays_overlap(a, array(3)) AS ov, size(flatten(array(a, a))) AS fl, array_repeat(7, 2)[1] AS rp FROM (SELECT n_nationkey, array(n_regionkey, 1, 3, n_nationkey) AS a FROM nation) x",
    "SELECT n_nationkey, list_contains(a, 2) AS c, array_to_string(a, ',') AS j, len(a)::INTEGER AS n, list_max(a) AS top, list_max(a) AS mx, list_min(a) AS mn, list_position(a, 3)::BIGINT AS p, len(list_distinct(a))::INTEGER AS d, a[-1] AS l, a[2] AS s, len(list_distinct(list_concat(a, [9])))::INTEGER AS u, len(list_distinct(list_intersect(a, [1, 2])))::INTEGER AS it, len(list_filter(list_distinct(a), lambda x: x <> 1))::INTEGER AS ex, list_contains(a, 3) AS ov, (len(a) * 2)::INTEGER AS fl, 7 AS rp FROM (SELECT n_nationkey, [n_regionkey, 1, 3, n_nationkey] AS a FROM nation) x",
)
R.sql(
    "fn_hof",
    "SELECT n_nationkey, array_join(transform(a, (x, i) -> CAST(x * 10 + i AS STRING)), ',') AS t, size(filter(a, x -> x > 2)) AS f, exists(a, x -> x = 3) AS e, forall(a, x -> x >= 0) AS fa, aggregate(a, 0, (s, x) -> s + x, s -> s * 2) AS g, zip_with(a, array(1, 1), (x, y) -> coalesce(x, 0) + coalesce(y, 0))[0] AS z FROM (SELECT n_nationkey, array(n_regionkey, 3, n_nationkey) AS a FROM nation) x",
    "SELECT n_nationkey, array_to_string(list_transform(a, lambda x, i: x * 10 + i - 1), ',') AS t, len(list_filter(a, lambda x: x > 2))::INTEGER AS f, list_contains(a, 3) AS e, true AS fa, (list_sum(a) * 2)::INTEGER AS g, a[1] + 1 AS z FROM (SELECT n_nationkey, [n_regionkey, 3, n_nationkey] AS a FROM nation) x",
)
R.sql(
    "fn_map",
    "SELECT n_nationkey, m['k'] AS v, array_join(array_sort(map_keys(m)), ',') AS ks, size(map_values(m)) AS n, map_concat(m, map('z', -1))['z'] AS z, str_to_map('a:1,b:2')['b'] AS s, map_from_arrays(array('p'), array(5))['p'] AS fa, size(map_entries(m)) AS en, transform_values(m, (k, v) -> v + 1)['k'] AS tv FROM (SELECT n_nationkey, map('k', n_regionkey, 'j', 2) AS m FROM nation) x",
    "SELECT n_nationkey, n_regionkey AS v, 'j,k' AS ks, 2 AS n, -1 AS z, '2' AS s, 5 AS fa, 2 AS en, n_regionkey + 1 AS tv FROM nation",
)
R.sql("fn_struct", "SELECT n_nationkey, struct(n_name, n_regionkey).n_name AS a, named_struct('x', n_nationkey).x AS b, to_json(named_struct('x', n_nationkey, 's', n_name)) AS j FROM nation", "SELECT n_nationkey, n_name AS a, n_nationkey AS b, '{\"x\":' || n_nationkey || ',\"s\":\"' || n_name || '\"}' AS j FROM nation")
R.sql(
    "fn_json",
    "SELECT event_id, get_json_object(j, '$.a.b') AS g, from_json(j, 'a struct<b: string>, n bigint').n AS n, t.u AS u, schema_of_json('{\"a\":1}') AS s, json_array_length('[1,2,3]') AS l FROM (SELECT event_id, to_json(named_struct('a', named_struct('b', event_type), 'n', user_id, 'u', 'x')) AS j FROM events) e LATERAL VIEW json_tuple(j, 'u') t AS u",
    "SELECT event_id, event_type AS g, user_id AS n, 'x' AS u, 'STRUCT<a: BIGINT>' AS s, 3 AS l FROM events",
)
R.sql("fn_hash", "SELECT r_name, md5(r_name) AS m, sha1(r_name) AS s1, sha2(r_name, 256) AS s2, crc32(r_name) AS c FROM region", "SELECT r_name, md5(r_name) AS m, sha1(r_name) AS s1, sha256(r_name) AS s2, (CASE r_name WHEN 'AFRICA' THEN 1723189541 WHEN 'AMERICA' THEN 2550494110 WHEN 'ASIA' THEN 1282864615 WHEN 'EUROPE' THEN 3094060888 WHEN 'MIDDLE EAST' THEN 127936550 END)::BIGINT AS c FROM region")
R.sql(
    "fn_cast",
    "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS i, bigint(l_quantity) AS b, CAST(l_tax AS STRING) AS s, CAST('12' AS SMALLINT) AS sm, CAST(1 AS BOOLEAN) AS bo, try_cast('abc' AS INT) AS na, CAST(CAST('2020-02-29' AS DATE) AS STRING) AS d, CAST(l_discount AS DECIMAL(10, 3)) = l_discount AS de, string(l_linenumber) AS st, double('1.5') AS dd FROM lineitem",
    "SELECT l_orderkey, l_linenumber, trunc(l_quantity)::INTEGER AS i, trunc(l_quantity)::BIGINT AS b, l_tax::VARCHAR AS s, 12::SMALLINT AS sm, true AS bo, TRY_CAST('abc' AS INTEGER) AS na, '2020-02-29' AS d, l_discount::DECIMAL(10, 3) = l_discount AS de, l_linenumber::VARCHAR AS st, 1.5::DOUBLE AS dd FROM lineitem",
)
R.sql("fn_decimal", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(15, 2))) AS STRING) AS s, CAST(max(CAST(l_tax AS DECIMAL(4, 2))) + CAST(1.10 AS DECIMAL(4, 2)) AS STRING) AS m FROM lineitem", "SELECT sum(l_extendedprice::DECIMAL(15, 2))::VARCHAR AS s, (max(l_tax::DECIMAL(4, 2)) + 1.10::DECIMAL(4, 2))::VARCHAR AS m FROM lineitem")
R.sql(
    "fn_xml",
    "SELECT r_regionkey, xpath_string(x, 'a/b') AS s, xpath_int(x, 'sum(a/c)') AS i, xpath_long(x, 'a/c[1]') AS l, xpath_short(x, 'a/c[1]') AS sh, xpath_double(x, 'a/d') AS d, xpath_float(x, 'a/d') AS f, xpath_number(x, 'a/d') AS n, xpath_boolean(x, 'a/b') AS bo, size(xpath(x, 'a/c/text()')) AS k FROM (SELECT r_regionkey, concat('<a><b>', r_name, '</b><c>', r_regionkey, '</c><c>2</c><d>1.5</d></a>') AS x FROM region) y",
    "SELECT r_regionkey, r_name AS s, r_regionkey + 2 AS i, r_regionkey::BIGINT AS l, r_regionkey::SMALLINT AS sh, 1.5::DOUBLE AS d, 1.5::FLOAT AS f, 1.5::DOUBLE AS n, true AS bo, 2 AS k FROM region",
)
R.sql("fn_reflect", "SELECT reflect('java.lang.Math', 'max', 3, 7) AS r, java_method('java.lang.Integer', 'toHexString', 255) AS j, current_database() AS d", "SELECT '7' AS r, 'ff' AS j, 'default' AS d")


@R.frame("SELECT count(*) AS n, -1321691492 AS h, 5602566077635097486 AS x, 1557323817::BIGINT AS c, count(*) AS ids, count(*) AS uuids, true AS even, true AS normal, 3::BIGINT AS parts FROM lineitem")
def fn_engine_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of fixed values; ids that are unique over the table; random numbers by mean and spread; partitions by their count."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey").repartition(3)
    fixed = F.lit("Spark"), F.array(F.lit(123)), F.lit(2)
    r = li.select(F.hash(*fixed).alias("h"), F.xxhash64(*fixed).alias("x"), F.crc32(F.lit("Spark")).alias("c"), F.monotonically_increasing_id().alias("i"), F.uuid().alias("u"), F.rand(1).alias("r"), F.randn(1).alias("g"), F.spark_partition_id().alias("p"))
    known = F.regexp_like("u", F.lit("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"))
    return r.agg(
        F.count("*").alias("n"), F.max("h").alias("h"), F.min("x").alias("x"), F.max("c").alias("c"), F.countDistinct("i").alias("ids"), F.countDistinct(F.when(known, F.col("u"))).alias("uuids"),
        ((F.min("r") >= 0) & (F.max("r") < 1) & (F.abs(F.avg("r") - 0.5) < 0.02) & (F.abs(F.stddev("r") - 12**-0.5) < 0.02)).alias("even"),
        ((F.abs(F.avg("g")) < 0.06) & (F.abs(F.stddev("g") - 1) < 0.06)).alias("normal"), F.countDistinct("p").alias("parts"),
    )


@R.frame("SELECT r_regionkey, true AS named, true AS placed FROM region")
def fn_input_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "region")
    return r.select("r_regionkey", F.input_file_name().contains("region.parquet").alias("named"), ((F.input_file_block_start() >= 0) & (F.input_file_block_length() > 0)).alias("placed"))


R.sql(
    "fn_more_math",
    "SELECT id, bround(id / 4.0D, 1) AS br, rint(id / 3.0D) AS ri, round(expm1(id / 10.0D), 9) AS e1, round(log1p(id), 9) AS l1, round(cosh(id / 5.0D), 6) AS ch, round(tanh(id / 5.0D), 9) AS th, shiftrightunsigned(id, 1) AS su, signum(id - 4) AS sg, round(log(2, id + 1), 9) AS lb FROM range(0, 10)",
    "SELECT range AS id, round_even(range / 4.0::DOUBLE, 1) AS br, round_even(range / 3.0::DOUBLE, 0) AS ri, round(exp(range / 10.0::DOUBLE) - 1, 9) AS e1, round(ln(1 + range), 9) AS l1, round(cosh(range / 5.0::DOUBLE), 6) AS ch, round(tanh(range / 5.0::DOUBLE), 9) AS th, range >> 1 AS su, sign(range - 4)::DOUBLE AS sg, round(ln(range + 1) / ln(2), 9) AS lb FROM range(0, 10)",
)
R.sql(
    "fn_more_array",
    "SELECT n_nationkey, array_join(sequence(1, n_regionkey + 1), ',') AS s, arrays_zip(array(n_nationkey), array(n_name))[0]['1'] AS z, map_from_entries(array(struct('k', n_nationkey)))['k'] AS m, size(array_remove(array(1, 2, n_regionkey), n_regionkey)) AS rm, array_join(array_sort(array(n_regionkey, 1, 9)), ',') AS so, cardinality(array(1, 2)) AS ca, array_join(shuffle(array(7)), '') AS sh, array_join(array_compact(array(n_regionkey, null)), ',') AS ac FROM nation",
    "SELECT n_nationkey, array_to_string(range(1, n_regionkey + 2), ',') AS s, n_name AS z, n_nationkey AS m, len(list_filter([1, 2, n_regionkey], lambda x: x <> n_regionkey))::INTEGER AS rm, array_to_string(list_sort([n_regionkey, 1, 9]), ',') AS so, 2 AS ca, '7' AS sh, n_regionkey::VARCHAR AS ac FROM nation",
)
R.sql(
    "fn_time_window",
    "SELECT CAST(unix_timestamp(window.start) AS BIGINT) AS start, count(*) AS n FROM (SELECT CAST(ts AS TIMESTAMP) AS t FROM events) e GROUP BY window(t, '6 hours')",
    "SELECT epoch_us(ts) // 1000000 // 21600 * 21600 AS start, count(*) AS n FROM events GROUP BY 1",
)
R.sql(
    "fn_date_trunc",
    "SELECT event_id, date_format(date_trunc('HOUR', ts), 'yyyy-MM-dd HH:mm:ss') AS h, date_format(date_trunc('WEEK', ts), 'yyyy-MM-dd') AS w, make_date(2020, 2, 29) = DATE '2020-02-29' AS md, CAST(timestampdiff(MINUTE, date_trunc('HOUR', ts), ts) AS BIGINT) AS m FROM events",
    "SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS h, strftime(date_trunc('week', ts), '%Y-%m-%d') AS w, true AS md, minute(ts)::BIGINT AS m FROM events",
)
