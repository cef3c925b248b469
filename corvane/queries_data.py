"""Queries of the general data-processing operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.operators import references as refs
from corvane.operators import rejects
from corvane.operators.rejects import Field
from corvane.tables import table

#: Columns of the delivered files, by position.
DELIVERED = {
    "users": (Field("uid"), Field("name", 32), Field("state", 8), Field("age")),
    "products": (Field("pid"), Field("name", 32), Field("price"), Field("stock")),
}


def _references(spark: SparkSession, sf_dir: str) -> list[refs.Reference]:
    return [
        refs.Reference("users", "uid", table(spark, sf_dir, "users"), "uid"),
        refs.Reference("products", "pid", table(spark, sf_dir, "products"), "pid"),
    ]


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.orphan_references(
        table(spark, sf_dir, "sales_orders"), _references(spark, sf_dir), ident="oid", at="placed_at"
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(spark, sf_dir).select("ref_table", "oid")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.orphan_report(orphans(spark, sf_dir))


def p3_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that orders refer to and that no record stands for any more."""
    orders = table(spark, sf_dir, "sales_orders").select("oid", "uid", "pid", "placed_at").distinct()
    ledger = None
    for ref in _references(spark, sf_dir):
        ledger = refs.apply_deltas(ledger, refs.existence_deltas(ref))
        ledger = refs.apply_deltas(ledger, refs.reference_deltas(orders, ref, "placed_at"))
    return refs.current_orphans(ledger)


def judged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.sort_lines(table(spark, sf_dir, "raw_lines"), DELIVERED)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.failed_lines(judged_lines(spark, sf_dir)).select("line_id", "reason")


def p5_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.valid_rows(judged_lines(spark, sf_dir), DELIVERED["users"], "users")


def p5_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.valid_rows(judged_lines(spark, sf_dir), DELIVERED["products"], "products")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.reject_report(judged_lines(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p3_current, p5_found, p5_users, p5_products, p5_report)}


def _orphan_sql(name: str, key: str) -> str:
    return f"""select distinct '{name}' as ref_table, o.oid, o.{key} as key, o.placed_at
    from sales_orders o where o.{key} is not null and not exists (
        select 1 from {name} t where t.{key} = o.{key}
        and (t.created_at is null or t.created_at <= o.placed_at)
        and (t.deleted_at is null or o.placed_at < t.deleted_at))"""


_ORPHANS = f"with orphans as ({_orphan_sql('users', 'uid')} union all {_orphan_sql('products', 'pid')})"


def _current_sql(name: str, key: str) -> str:
    return f"""select '{name}' as ref_table, {key} as key, count(*) as refs
    from (select distinct oid, uid, pid, placed_at from sales_orders) o
    where {key} is not null and not exists (select 1 from {name} t where t.{key} = o.{key} and t.deleted_at is null)
    group by {key}"""


_PLAIN = r""" *(?:"(?:[^"]|"")*"|[^",]*?) *"""
_GROUPED = r""" *(?:"((?:[^"]|"")*)"|([^",]*?)) *"""
_FOUR = "^" + ",".join([_GROUPED] * 4) + "$"


def _value(i: int) -> str:
    part = lambda k: f"regexp_extract(raw_text, '{_FOUR}', {k})"
    return f"""replace({part(2 * i + 1)}, '""', '"') || {part(2 * i + 2)}"""


def _good(i: int, field: Field) -> str:
    if field.is_int:
        number = f"try_cast(v{i} as hugeint)"
        return f"(regexp_full_match(v{i}, '-?[0-9]+') and coalesce({number} between -2147483648 and 2147483647, false))"
    return f"(strlen(v{i}) between 1 and {field.max_bytes} and not regexp_matches(v{i}, '[\\x00-\\x1f]|\\x{{FFFD}}'))"


def _all_good(dest: str) -> str:
    return " and ".join(_good(i, f) for i, f in enumerate(DELIVERED[dest]))


_LINES = rf"""with parts as (
    select *, {", ".join(f"{_value(i)} as v{i}" for i in range(4))} from raw_lines
    where line_no <> 1 and not regexp_full_match(raw_text, ' *')
), judged as (
    select *, case when not regexp_matches(raw_text, '^{_PLAIN}(?:,{_PLAIN})*$') then 'quoting'
        when not regexp_matches(raw_text, '{_FOUR}') then 'columns'
        when dest = 'users' and not ({_all_good("users")}) then 'value'
        when dest = 'products' and not ({_all_good("products")}) then 'value' end as reason
    from parts
)"""


def _loaded(dest: str) -> str:
    cols = ", ".join(
        (f"cast(v{i} as int)" if f.is_int else f"v{i}") + f" as {f.name}" for i, f in enumerate(DELIVERED[dest])
    )
    return f"{_LINES} select line_id, {cols} from judged where reason is null and dest = '{dest}'"


SQL = {
    "p3_found": f"{_ORPHANS} select ref_table, oid from orphans",
    "p3_report": f"""{_ORPHANS} select ref_table, strftime(placed_at, '%Y-%m') as month,
        count(*) as n_orphans, count(distinct key) as n_keys from orphans group by 1, 2""",
    "p3_current": f"{_current_sql('users', 'uid')} union all {_current_sql('products', 'pid')}",
    "p5_found": f"{_LINES} select line_id, reason from judged where reason is not null",
    "p5_users": _loaded("users"),
    "p5_products": _loaded("products"),
    "p5_report": f"""{_LINES} select file_name, dest, count(*) filter (reason is null) as n_valid,
        count(*) filter (reason = 'quoting') as n_quoting, count(*) filter (reason = 'columns') as n_columns,
        count(*) filter (reason = 'value') as n_value from judged group by 1, 2""",
}
