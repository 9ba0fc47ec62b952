"""SQL twins of the bootstrap: hashes, draws and intervals."""

from __future__ import annotations

#: Replicates of every cluster bootstrap.
REPS = 2000

H60 = "('0x'||substr(sha256({}),1,15))::bigint"


def draws_sql(source: str, key: str, reps: int, context: str, within: str = "") -> str:
    """SQL twin of component_draws: `source` yields (within.., key) rows."""
    w = f"{within}, " if within else ""
    part = f"partition by {within}" if within else ""
    ctx = f"'{context}|'||" + "".join(f"{c}::varchar||'|'||" for c in within.split(", ") if c)
    return f"""select i.{key}, {", ".join("i." + c for c in within.split(", ") if c) + ", " if within else ""}d.replicate, d.multiplicity from (
      select {w}r replicate, ({H60.format(f"{ctx}r||'|'||key_index")} % k) key_index, count(*) multiplicity from (
        select *, unnest(range({reps})) r from ({index_sql(source, key, within)})) group by all) d
      join ({index_sql(source, key, within)}) i on i.key_index = d.key_index {"".join(f" and i.{c} = d.{c}" for c in within.split(", ") if c)}"""


def index_sql(source: str, key: str, within: str = "") -> str:
    w = f"{within}, " if within else ""
    part = f"partition by {within} " if within else ""
    return f"""select {w}{key}, row_number() over ({part}order by {H60.format(f"{key}::varchar")} % 64, {key}) - 1 key_index,
      count(*) over ({part}) k from (select distinct {w}{key} from {source})"""


def ci_sql(cols, digits=9):
    return ", ".join(f"round(quantile_cont({c}, 0.025), {digits}) {c}_lower, round(quantile_cont({c}, 0.975), {digits}) {c}_upper, count({c}) {c}_finite" for c in cols)
