"""Adapter views: map the driver's generic tables onto machine-telemetry shapes.

Each view is one SQL text with ``{table}`` placeholders.  Spark binds the
placeholders to DataFrames (``spark.sql(text, lineitem=df)``), DuckDB to its
pre-registered view names, so both engines see the same inputs.  Only the md5
chunk → number conversion differs by dialect.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from millwright.sources.catalog import DOMAIN_SPECS, PLANT_SENSORS
from millwright.sources.tables import table


def md5_u_sql(m: str, i: int, dialect: str) -> str:
    start = 1 + 8 * (i - 1)
    chunk = f"substr({m},{start},8)"
    if dialect == "spark":
        num = f"cast(conv({chunk},16,10) as double)"
    else:
        num = f"cast(cast(('0x'||{chunk}) as bigint) as double)"
    return f"({num}/4294967296.0)"


def hash_uniform_sql(key_sql: str, dialect: str, salt: str | None = None) -> str:
    k = f"cast({key_sql} as varchar)" if dialect == "duckdb" else f"cast({key_sql} as string)"
    if salt is not None:
        k = f"concat({k},'|','{salt}')"
    return md5_u_sql(f"md5({k})", 1, dialect)


def hash_normal_sql(key_sql: str, salt: str, dialect: str) -> str:
    m = f"md5(concat({key_sql},'|','{salt}'))"
    s = "+".join(md5_u_sql(m, i, dialect) for i in range(1, 5))
    return f"((({s})-2.0)*sqrt(3.0))"


TEL_CLEAN = """
select concat_ws('|',l_orderkey,l_linenumber,l_partkey,l_suppkey,
                 cast(round(l_extendedprice*100) as bigint)) rk,
       l_orderkey*31+l_linenumber*17+l_partkey*7+l_suppkey h,
       case l_returnflag when 'A' then 'L' when 'N' then 'M' else 'H' end tier,
       round(295+l_discount*100,1) air,
       round(302.5+l_discount*100+l_tax*62.5,1) proc,
       round(1250+(l_extendedprice-900)*0.007,0) rpm,
       25+l_quantity*0.5 torque,
       cast((l_partkey*7+l_suppkey*3+l_linenumber*11)%226 as double) wear
from {lineitem}
"""

TEL_FLAGS = """
select *, case when wear>=200+h%41 then 1 else 0 end twf,
  case when proc-air<8.6 and rpm<1380 then 1 else 0 end hdf,
  case when torque*rpm*2*pi()/60<3500 or torque*rpm*2*pi()/60>9000 then 1 else 0 end pwf,
  case when wear*torque>case tier when 'L' then 11000 when 'M' then 12000 else 13000 end then 1 else 0 end osf,
  case when h%997=0 then 1 else 0 end rnf
from {tel_clean}
"""

TEL_RAW = """
select * from (
 select rk, h, case when h%101=5 then null else tier end tier,
  case when (h+13)%83=0 then null when (h*7+1)%67=1 then air   +(case when h%2=0 then 5 else -5 end)*3.16  else air    end air,
  case when (h+26)%83=0 then null when (h*7+2)%67=1 then proc  +(case when h%2=0 then 5 else -5 end)*3.6   else proc   end proc,
  case when (h+39)%83=0 then null when (h*7+3)%67=1 then rpm   +(case when h%2=0 then 5 else -5 end)*210.0 else rpm    end rpm,
  case when (h+52)%83=0 then null when (h*7+4)%67=1 then torque+(case when h%2=0 then 5 else -5 end)*7.2   else torque end torque,
  case when (h+65)%83=0 then null when (h*7+5)%67=1 then wear  +(case when h%2=0 then 5 else -5 end)*65.0  else wear   end wear
 from {tel_clean}) a
union all
select * from (
 select rk, h, case when h%101=5 then null else tier end tier,
  case when (h+13)%83=0 then null when (h*7+1)%67=1 then air   +(case when h%2=0 then 5 else -5 end)*3.16  else air    end air,
  case when (h+26)%83=0 then null when (h*7+2)%67=1 then proc  +(case when h%2=0 then 5 else -5 end)*3.6   else proc   end proc,
  case when (h+39)%83=0 then null when (h*7+3)%67=1 then rpm   +(case when h%2=0 then 5 else -5 end)*210.0 else rpm    end rpm,
  case when (h+52)%83=0 then null when (h*7+4)%67=1 then torque+(case when h%2=0 then 5 else -5 end)*7.2   else torque end torque,
  case when (h+65)%83=0 then null when (h*7+5)%67=1 then wear  +(case when h%2=0 then 5 else -5 end)*65.0  else wear   end wear
 from {tel_clean} where h%401=0) b
"""

# Run-to-failure panel.  The remaining turbofan sensors follow the same form
# (baseline + slope * progress^2.4 + value noise); tier is a unit attribute.
UNIT_CYCLES = """
select unit_id, cast(cycle as double) cycle, max_cycle, value,
  case when unit_id%5=0 then 'H' when unit_id%5<3 then 'M' else 'L' end tier,
  round(642.15 + 1.85*power(cast(cycle as double)/max_cycle,2.4)+value/500,2) s2,
  round(1585.2 + 18.5*power(cast(cycle as double)/max_cycle,2.4)+value/50,2) s3,
  round(1401.5 + 28.0*power(cast(cycle as double)/max_cycle,2.4)+value/40,2) s4,
  round(554.1 - 2.9*power(cast(cycle as double)/max_cycle,2.4)+value/800,2) s7,
  round(2388.02 + 0.22*power(cast(cycle as double)/max_cycle,2.4)+value/9000,2) s8,
  round(9050.0 + 38.0*power(cast(cycle as double)/max_cycle,2.4)+value/40,2) s9,
  round(47.35 + 1.15*power(cast(cycle as double)/max_cycle,2.4)+value/2500,2) s11,
  round(521.95 - 2.35*power(cast(cycle as double)/max_cycle,2.4)+value/900,2) s12,
  round(38.95 - 0.65*power(cast(cycle as double)/max_cycle,2.4)+value/3000,2) s20,
  round(23.38 - 0.42*power(cast(cycle as double)/max_cycle,2.4)+value/4000,3) s21
from (select user_id unit_id, value,
  row_number() over (partition by user_id order by ts,event_id) cycle,
  count(*) over (partition by user_id) max_cycle from {events}) c
"""

MINORITY_VEC = """
select vec_id, embedding, case when label=0 then 1 else 0 end minority from {embeddings}
"""


#: Fractions in about [0, 1] of the given columns that tel_clean carries: quantity, discount, tax,
#: part/supplier key, price and the two row keys.
FRACTIONS = [
    "(torque-25.5)/24.5",
    "(air-295.0)/10.0",
    "(proc-air-7.5)/5.0",
    "wear/225.0",
    "(rpm-1250.0)/730.0",
    "cast(h%1000 as double)/999.0",
    "cast(h%463 as double)/462.0",
]
SPREAD = 2.2   # a sensor's values reach so many of its standard deviations to either side


def _spec_sensor_sql(sensors, dialect: str) -> str:
    """Each sensor is an affine image of a given column, clamped to the sensor's range, two decimals."""
    q = (lambda n: f"`{n}`") if dialect == "spark" else (lambda n: f'"{n}"')
    parts = []
    for i, (name, mean, std, lo, hi) in enumerate(sensors):
        num = lambda v: f"cast({v} as double)"
        v = f"{num(mean)}+{num(std)}*({num(2 * SPREAD)}*({FRACTIONS[i % len(FRACTIONS)]})-{num(SPREAD)})"
        parts.append(f"cast(floor(least(greatest({v}, {num(lo)}), {num(hi)})*100+0.5) as double)/100 {q(name)}")
    return ",\n  ".join(parts)


def domain_sql(key: str, dialect: str) -> str:
    sensors = PLANT_SENSORS if key == "plant" else DOMAIN_SPECS[key]["sensors"]
    return f"select rk, h, tier,\n  {_spec_sensor_sql(sensors, dialect)}\nfrom {{tel_clean}}"


DEPENDS = {
    "tel_clean": ["lineitem"],
    "tel_flags": ["tel_clean"],
    "tel_raw": ["tel_clean"],
    "unit_cycles": ["events"],
    "minority_vec": ["embeddings"],
}


def view_sql(name: str, dialect: str) -> str:
    if name == "tel_clean":
        return TEL_CLEAN
    if name == "tel_flags":
        return TEL_FLAGS
    if name == "tel_raw":
        return TEL_RAW
    if name == "unit_cycles":
        return UNIT_CYCLES
    if name == "minority_vec":
        return MINORITY_VEC
    if name == "plant" or name.startswith("domain_"):
        return domain_sql("plant" if name == "plant" else name[len("domain_"):], dialect)
    raise KeyError(name)


def view_deps(name: str) -> list[str]:
    if name in DEPENDS:
        return DEPENDS[name]
    if name == "plant" or name.startswith("domain_"):
        return ["tel_clean"]
    raise KeyError(name)


def fixture(spark: SparkSession, sf_dir: str, name: str, _memo: dict | None = None) -> DataFrame:
    """Spark DataFrame for an adapter view (base tables read from ``sf_dir``)."""
    memo = {} if _memo is None else _memo
    if name in memo:
        return memo[name]
    deps = {}
    for d in view_deps(name):
        if d in ("lineitem", "events", "embeddings"):
            deps[d] = table(spark, sf_dir, d)
        else:
            deps[d] = fixture(spark, sf_dir, d, memo)
    df = spark.sql(view_sql(name, "spark"), **deps)
    memo[name] = df
    return df


def duckdb_ctes(names: list[str]) -> list[tuple[str, str]]:
    """Ordered (name, sql) CTE list for DuckDB, dependencies first."""
    out: list[tuple[str, str]] = []
    seen: set[str] = set()

    def visit(n: str):
        if n in seen or n in ("lineitem", "events", "embeddings"):
            return
        for d in view_deps(n):
            visit(d)
        seen.add(n)
        text = view_sql(n, "duckdb")
        fmt = {d: d for d in view_deps(n)}
        out.append((n, text.format(**fmt)))

    for n in names:
        visit(n)
    return out


def oracle(views: list[str], body: str, ctes: list[tuple[str, str]] | None = None) -> str:
    """Compose a DuckDB oracle: adapter views + extra CTEs + final select."""
    parts = duckdb_ctes(views) + list(ctes or [])
    if not parts:
        return body
    head = "with " + ",\n".join(f"{n} as ({s})" for n, s in parts)
    b = body.lstrip()
    if b[:5].lower() == "with ":
        return head + ",\n" + b[5:]
    return head + "\n" + body


@lru_cache(maxsize=None)
def domain_keys() -> tuple[str, ...]:
    return tuple(DOMAIN_SPECS.keys())
